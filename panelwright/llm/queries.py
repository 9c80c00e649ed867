"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import cut, held_out, shared_folder, table, word_count
from panelwright.shipping import ship


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size and how much of it the mix takes; texts are read once."""
    from panelwright.llm.mixing import mix

    sized = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mix(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.topk import top_k

    ship(spark)
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.toxicity import toxicity

    ship(spark)
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache that starts empty, so that every distinct text is encoded."""
    from panelwright.llm.tokens import token_counts

    ship(spark)
    cache = f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"), cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.suffix import remove_repeats

    ship(spark)
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.minhash import near_duplicates

    ship(spark)
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.quality import quality

    ship(spark)
    scored = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their words into sequences of 512 to 4,096."""
    from panelwright.llm.packing import pack

    ship(spark)
    return pack(cut(table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("size"))))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.embed import near_vectors

    ship(spark)
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_idfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.idfile import id_files

    ship(spark)
    return id_files(table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.codes import compressed

    ship(spark)
    return compressed(table(spark, sf_dir, "embeddings"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.ranked import top_documents

    ship(spark)
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.llm.lm import log_probabilities

    ship(spark)
    return log_probabilities(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix, op2_topk, op3_toxicity, op4_tokens, op5_suffix, op6_minhash, op7_quality, op8_pack, op9_embeddings, op10_idfile, op11_codes, op12_ranked, op13_lm)}

ORACLE_SQL: dict[str, str] = {
    "op1_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4) AS bucket
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS pos,
             (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - coalesce(CAST(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
             / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight::DOUBLE, source ASC NULLS LAST)),
g AS (SELECT *, cap / weight::DOUBLE <= level AS is_full FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE weight * (SELECT min_by(level, pos) FROM g WHERE NOT is_full) END AS target FROM g),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216) AS BIGINT) ELSE 0 END AS step,
             CAST('0x' || substr(md5('0:' || coalesce('s' || source, 'n')), 1, 6) AS BIGINT) AS start FROM t),
r AS (SELECT doc_id, size, source, row_number() OVER (PARTITION BY source ORDER BY size, bucket, doc_id NULLS FIRST) AS i FROM d)
SELECT doc_id, size, source_size, target,
       CAST((((start + i * step) >> 24) - ((start + (i - 1) * step) >> 24)) * size AS BIGINT) AS taken
FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source
""",
    "op2_topk": """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
    "op9_embeddings": """
WITH RECURSIVE u AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a AS id, a AS reached FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT id, min(reached) AS component FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT CAST(e.vec_id AS BIGINT) AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(coalesce(c.component, e.vec_id) AS BIGINT) AS component_id,
       coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.id = e.vec_id LEFT JOIN c ON c.id = e.vec_id
""",
    "op11_codes": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id ASC NULLS LAST) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT id, p, e[p * 16 + 1 : p * 16 + 16] AS y FROM v, range(4) AS ps(p)),
b0 AS (SELECT p, id - 1 AS k, y FROM x WHERE id <= 256),
b1 AS (
  SELECT b0.p, b0.k, coalesce(m.y, b0.y) AS y FROM b0 LEFT JOIN (
    SELECT p, k, list(s ORDER BY d) AS y FROM (
      SELECT p, k, d, CAST(floor(sum(y[d]) / count(*)) AS BIGINT) AS s FROM (
        SELECT x.p, x.id, x.y, arg_min(b.k, (list_sum(list_transform(list_zip(x.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) * 256 + b.k) AS k
        FROM x JOIN b0 b ON x.p = b.p GROUP BY x.p, x.id, x.y), range(1, 17) AS ds(d) GROUP BY p, k, d) GROUP BY p, k) m
  ON m.p = b0.p AND m.k = b0.k),
b2 AS (
  SELECT b1.p, b1.k, coalesce(m.y, b1.y) AS y FROM b1 LEFT JOIN (
    SELECT p, k, list(s ORDER BY d) AS y FROM (
      SELECT p, k, d, CAST(floor(sum(y[d]) / count(*)) AS BIGINT) AS s FROM (
        SELECT x.p, x.id, x.y, arg_min(b.k, (list_sum(list_transform(list_zip(x.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) * 256 + b.k) AS k
        FROM x JOIN b1 b ON x.p = b.p GROUP BY x.p, x.id, x.y), range(1, 17) AS ds(d) GROUP BY p, k, d) GROUP BY p, k) m
  ON m.p = b1.p AND m.k = b1.k),
b3 AS (
  SELECT b2.p, b2.k, coalesce(m.y, b2.y) AS y FROM b2 LEFT JOIN (
    SELECT p, k, list(s ORDER BY d) AS y FROM (
      SELECT p, k, d, CAST(floor(sum(y[d]) / count(*)) AS BIGINT) AS s FROM (
        SELECT x.p, x.id, x.y, arg_min(b.k, (list_sum(list_transform(list_zip(x.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) * 256 + b.k) AS k
        FROM x JOIN b2 b ON x.p = b.p GROUP BY x.p, x.id, x.y), range(1, 17) AS ds(d) GROUP BY p, k, d) GROUP BY p, k) m
  ON m.p = b2.p AND m.k = b2.k),
b4 AS (
  SELECT b3.p, b3.k, coalesce(m.y, b3.y) AS y FROM b3 LEFT JOIN (
    SELECT p, k, list(s ORDER BY d) AS y FROM (
      SELECT p, k, d, CAST(floor(sum(y[d]) / count(*)) AS BIGINT) AS s FROM (
        SELECT x.p, x.id, x.y, arg_min(b.k, (list_sum(list_transform(list_zip(x.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) * 256 + b.k) AS k
        FROM x JOIN b3 b ON x.p = b.p GROUP BY x.p, x.id, x.y), range(1, 17) AS ds(d) GROUP BY p, k, d) GROUP BY p, k) m
  ON m.p = b3.p AND m.k = b3.k),
c AS (
  SELECT id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM (
    SELECT x.p, x.id, min((list_sum(list_transform(list_zip(x.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) * 256 + b.k) AS best, best % 256 AS k
    FROM x JOIN b4 b ON x.p = b.p GROUP BY x.p, x.id) GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, k)) AS digest FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM v JOIN c USING (id), h
""",
    "op12_ranked": r"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
i AS MATERIALIZED (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM t WHERE len(words) > 0),
q AS (SELECT i, word, count(*) AS times FROM (SELECT i, unnest(words) AS word FROM i) GROUP BY ALL),
p AS MATERIALIZED (SELECT d, word, count(*) AS tf FROM (SELECT d, unnest(words) AS word FROM t) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
w AS (SELECT word, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT word, count(*) AS df FROM p GROUP BY word), s),
m AS (SELECT d, doc_id, 100 - 25 + ((25 * CAST(len(words) AS BIGINT) * n_docs) // n_terms) AS m FROM t, s WHERE len(words) > 0),
r AS (SELECT i, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS score FROM p JOIN q USING (word) JOIN w USING (word) JOIN m USING (d) GROUP BY i, d),
k AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM r JOIN m USING (d) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, CAST(score AS BIGINT) AS score FROM k JOIN i USING (i) WHERE rank <= 20
""",
}
