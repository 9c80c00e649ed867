"""What the operators do with awkward tables: clashing and odd names, nulls, no rows, repeated rows, one class of labels, very long texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm.embed import near_vectors
from panelwright.llm.idfile import id_files
from panelwright.llm.minhash import near_duplicates
from panelwright.llm.mixing import mix
from panelwright.llm.packing import pack
from panelwright.llm.quality import quality
from panelwright.llm.suffix import remove_repeats
from panelwright.llm.tokens import token_counts
from panelwright.llm.topk import top_k
from panelwright.llm.toxicity import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
ODD = ["a.b", "tick`ed", "score", "predicted", "n_bytes", "n_removed", "copies", "target", "source_size", "n_tokens", "over_limit", "mix_text", "mix_id", "mix_c0", "digest", "kept_text", "size"]


def rows():
    long = "many words in a very long text " * 20_000
    some = [(i, f"plain words of number {i} and {i % 3} more of them", "en", "s", 9) for i in range(1, 60)]
    return [*some, some[3], some[3], (None, "no id here", None, None, None), (None, None, "en", "s", 1), (60, None, "en", "t", 0), (61, "", "en", None, 0), (62, long, "en", "s", 1), (63, long + "end", "en", "t", 1), (5, "another text of an id that is there", "en", "s", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 60)], LABELS)


def operators(spark, labels, folder):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    return {
        "mix": (lambda d: mix(d, size="n_chars"), {"source_size", "target", "copies"}), "toxicity": (lambda d: toxicity(d, labels), {"ratio", "worst", "score", "predicted"}), "quality": (lambda d: quality(d, labels), {"score", "predicted"}),
        "tokens": (lambda d: token_counts(d, path, folder), {"n_bytes", "n_tokens", "over_limit"}), "suffix": (remove_repeats, {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"}),
        "minhash": (near_duplicates, None), "pack": (lambda d: pack(d, "n_chars"), None), "ids": (lambda d: id_files(d, path), None),
    }


@pytest.mark.parametrize("name", ["mix", "toxicity", "quality", "tokens", "suffix", "minhash", "pack", "ids"])
def test_odd_names_and_rows(spark, docs, labels, name, tmp_path):
    run, outputs = operators(spark, labels, str(tmp_path / "c"))[name]
    d = docs
    for c in ODD:
        d = d.withColumn(c, F.lit("x")) if "." not in c and "`" not in c else d.select("*", F.lit("x").alias(c))
    out = run(d)
    got = out.collect()
    if outputs:
        assert out.columns[-len(outputs) :] != [] and set(out.columns) == set(d.columns) | outputs and len(out.columns) == len(set(out.columns))
        assert all(r["a.b"] == "x" and r["tick`ed"] == "x" and r["digest"] == "x" for r in got)
    plain = run(docs)
    key = ["doc_id", *sorted(outputs - {"bin_id"})] if outputs else plain.columns
    assert Counter(tuple(r[c] for c in key) for r in got) == Counter(tuple(r[c] for c in key) for r in plain.select(*key).collect())
    if name != "pack":  # a document may have several pieces
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows())


@pytest.mark.parametrize("name", ["mix", "toxicity", "quality", "tokens", "suffix", "minhash", "pack", "ids"])
def test_empty_tables(spark, labels, name, tmp_path):
    run, _ = operators(spark, labels, str(tmp_path / "c"))[name]
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def test_one_class_of_labels(spark, docs):
    for only in (0, 1):
        labels = spark.createDataFrame([(i, only, only) for i in range(1, 60)], LABELS)
        for run in (toxicity, quality):
            assert {r["score"] for r in run(docs, labels).collect()} == {0.0}


def test_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(empty).count() == 0 and top_k(empty).count() == 0
    same = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in near_vectors(same).collect()) == Counter({(1, 3, 1, True): 2, (50, 3, 1, False): 2, (2, 0, 2, True): 1})
    assert [(r["rank"], r["vec_id"], r["score"]) for r in top_k(same).orderBy("rank").collect()] == [(1, 1, 65536), (2, 1, 65536), (3, 2, 0)]


def test_pipeline_on_awkward_rows(spark, docs, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_near_copies(spark, d, str(tmp_path))
    of = Counter(r["doc_id"] for r in kept.collect())
    assert of[5] == 2 and of[4] == 1 and of[None] == 2 and of[62] == 1 and of[63] == 0  # both texts of 5 stay, the long near copy goes
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "bin_id"}


def test_pipeline_without_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
