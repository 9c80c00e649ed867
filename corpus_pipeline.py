"""A corpus pipeline: reject toxic documents, keep one of each near-duplicate group, cut repeated passages, mix sources, pack sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for
the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import cut, discard, scratch, shared_folder, table, word_count
from panelwright.llm.minhash import near_duplicates
from panelwright.llm.mixing import mix
from panelwright.llm.packing import pack
from panelwright.llm.suffix import remove_repeats
from panelwright.llm.toxicity import toxicity
from panelwright.shipping import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models call toxic go."""
    ship(spark)
    return toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays, each of its texts once; rows without an id all stay."""
    ship(spark)
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    once = docs.join(kept, "doc_id", "left_semi").withColumn("mix_digest", F.xxhash64("text")).dropDuplicates(["doc_id", "mix_digest"])
    return once.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a smaller document holds are cut out; n_chars follows the text."""
    ship(spark)
    out = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": text, "n_chars": n}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    The mix sees a row's place, id, source and size; only then do the texts follow, once. The place holds
    as docs is a stored table, which both readings split alike.
    """
    placed = docs.withColumn("mix_place", F.monotonically_increasing_id())
    taken = mix(cut(placed.select("mix_place", "doc_id", "source", word_count(F.col("text")).alias("size")))).where("copies > 0")
    copies = taken.select("mix_place", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("mix_copy"))
    return placed.join(copies, "mix_place").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words go: bins of 512 to 4,096 words."""
    ship(spark)
    return pack(cut(docs.select("doc_id", word_count(F.col("text")).alias("size"))))


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("mix", mix_sources), ("pack", pack_sequences)]

#: The toxicity and near-duplicate stages learn and hash; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted once the next one is written, and what a stage wrote in between with it."""
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
