"""Reading and writing the panel tables: Parquet partitioned by year, factors also by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.panel import latest
from panelwright.sources.folders import exists, remove


def scan(spark: SparkSession, paths: str | list[str], first: str | None = None, last: str | None = None, on: str = "date") -> DataFrame:
    """Parquet files within dates; the bounds reach the scan as pushed filters, and as partition filters where `on` is a partition column."""
    d = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if first is not None:
        d = d.where(F.col(on) >= F.lit(first))
    return d if last is None else d.where(F.col(on) <= F.lit(last))


def scan_tolerant(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of different schemas by column name, missing columns null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_factor(spark: SparkSession, folder: str, names: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """(date, code, factor, value) of some factors; a table with score instead of value is read as value."""
    d = spark.read.parquet(folder).where(F.col("factor").isin(names))
    if first is not None:
        d = d.where((F.col("year") >= int(first[:4])) & (F.col("date") >= F.lit(first)))
    if last is not None:
        d = d.where((F.col("year") <= int(last[:4])) & (F.col("date") <= F.lit(last)))
    value = F.col("score") if "value" not in d.columns else F.coalesce("value", "score") if "score" in d.columns else F.col("value")
    return d.select("date", "code", "factor", value.alias("value"))


def write_partitioned(df: DataFrame, folder: str, by: list[str]) -> None:
    """Replace just the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of the same key; columns by name. new holds each key once."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(spark: SparkSession, folder: str, new: DataFrame, keys: list[str], by: str, batch: int) -> None:
    """Merge new into a stored table partitioned by `by`: of one key the row of the highest batch stays, and just the partitions that new has rows in are written.

    Rows carry the batch that brought them (_batch), so a batch that is delivered again, or after a later one,
    changes nothing. A key that stands twice in a batch keeps its greatest row. A job that dies may leave
    some partitions merged and others not; delivering the batch again finishes it.
    """
    new = new.withColumn("_batch", F.lit(batch).cast("long"))
    touched = [r[0] for r in new.select(by).distinct().collect()]  # partitions, not rows
    if not touched:
        return
    rows = new
    if exists(spark, folder):
        rows = spark.read.schema(new.schema).parquet(folder).where(F.col(by).isin(touched)).unionByName(new)
    rest = [F.desc(c) for c in new.columns if c not in (*keys, "_batch")]
    aside = f"{folder.rstrip('/')}-merging-{uuid.uuid4().hex}"
    latest(rows, keys, [F.desc("_batch"), *rest]).write.partitionBy(by).parquet(aside)
    try:
        write_partitioned(spark.read.schema(new.schema).parquet(aside), folder, [by])
    finally:
        remove(spark, aside)


def keep_last(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All parts' rows, of one key that of the latest part."""
    numbered = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return latest(out, keys, [F.desc("_part")]).drop("_part")


def append_years(spark: SparkSession, folder: str, new: DataFrame, keys: list[str]) -> None:
    """Merge new into the years that it holds, its rows winning; other years are not touched. The merged years go by a new folder beside the old, as Spark does not overwrite what it reads."""
    years = [r[0] for r in new.select("year").distinct().collect()]
    old = spark.read.parquet(folder).where(F.col("year").isin(years))
    merged = keep_last([old, new], keys)
    aside = f"{folder.rstrip('/')}-merging-{uuid.uuid4().hex}"  # two writers never share it
    merged.write.partitionBy("year").parquet(aside)
    try:
        write_partitioned(spark.read.parquet(aside), folder, ["year"])
    finally:
        remove(spark, aside)


def window_merge(old: DataFrame, new: DataFrame, since: str, on: str = "date") -> DataFrame:
    """old before `since`, new from there."""
    return old.where(F.col(on) < F.lit(since)).unionByName(new.where(F.col(on) >= F.lit(since)))
