"""The corpus pipeline, stage by stage, on a small corpus."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P


def test_stages_on_a_small_corpus(spark, tmp_path):
    r = random.Random(1)
    words = ["".join(r.choice("aeionstr") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, labels = [], []
    passage = prose(40)
    for i in range(900):
        t = prose(r.randint(20, 60))
        if i % 4 == 0:
            t = t.replace(" ", " grubnik ", 3)
        if i % 10 == 1:
            t = t + " " + passage
        rows.append((i, t, "en", f"s{i % 5}", len(t)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, rows[1][1], "en", "s1", 1), (1001, None, "en", None, None), (1002, "", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = docs
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        seen[name] = d
        if name != "pack":
            assert d.columns == docs.columns
    clean = {r["doc_id"] for r in seen["toxicity"].collect()}
    assert {1000, 1001, 1002} <= clean and len({i for i, _, t in labels if t} & clean) < 22 and len({i for i, _, t in labels if not t} & clean) > 660
    near = {r["doc_id"] for r in seen["near_dedup"].collect()}
    assert 1 in near and 1000 not in near and 1001 in near
    assert seen["suffix_dedup"].where(F.col("text").contains(passage)).count() == 1
    assert seen["suffix_dedup"].count() == len(near)
    assert seen["mix"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert seen["pack"].agg(F.sum("length")).first()[0] == sum(len((r["text"] or "").split()) for r in seen["mix"].collect())
    assert len(P.STAGES) == 5
