"""Mixing sources to target weights by systematic sampling, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import column, cut, masked

#: Copies are counted in units of 2**-24, so that sums of expected copies are exact in longs.
UNIT = 1 << 24


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Water-fill `share` of all sizes over sources.

    sizes: one row per source (source, source_size). Sources in code-point order, null last, take the
    weights in turn; a target stops at `most` times its source's size and the excess goes to the others by
    weight. Returns source, source_size, target. The table has a row per source, so its windows see
    sources only, never documents. Sources of size 0 get target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    # Sources fill in the order of cap / weight; level = what is left for the rest, a unit of their weight.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", left / rest).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level")).withColumn("at", F.row_number().over(fill))
    # The first source that does not fill sets the level of itself and of all after it.
    level = F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(everything)
    s = s.withColumn("final", level["level"])
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def mix(docs: DataFrame, size: str = "size", seed: int = 0, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """How often the mix takes each row of docs.

    docs needs doc_id, source and the long column `size` (at least 0). Adds source_size, target and copies
    (long). Within a source every document expects target / source_size copies. Documents stand in the
    order (size, digest of doc_id, doc_id); their expected copies are summed from a random start of the
    source, and a document is taken once for each integer that its stretch crosses. Standing in order of
    size, each stretch of the source takes its share, so the words taken stay within about one longest
    document of the target. No document is taken more than `most` times.

    Null sources form one source, null ids stand first, repeated rows are separate documents, empty
    documents take part with size 0, an empty table gives an empty table. Extra columns pass through,
    whatever their names; an output replaces an input column of its name.

    No task gets a source: ranks are made of counts by (source, size), counts by (source, size, bucket of
    65,536 by the id's digest) and a row number within such a bucket, so a source with a third of all rows,
    or one size that they all share, is dealt out by bucket.
    """
    hidden, shown = masked(docs, "source_size", "target", "copies")
    docs = docs.select(*hidden, "doc_id", "source", column(size).alias("mix_units"))
    bucket = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 4)
    d = docs.select("*", F.col("source").alias("mix_source"), F.coalesce("mix_units", F.lit(0)).cast("long").alias("mix_size"), bucket.alias("mix_bucket"))
    cells = cut(d.groupBy("mix_source", "mix_size", "mix_bucket").agg(F.count("*").alias("mix_n")))
    of_size = cells.groupBy("mix_source", "mix_size").agg(F.sum("mix_n").alias("mix_n"))
    up_to = Window.unboundedPreceding, -1
    of_size = of_size.select("mix_source", "mix_size", F.coalesce(F.sum("mix_n").over(Window.partitionBy("mix_source").orderBy("mix_size").rowsBetween(*up_to)), F.lit(0)).alias("mix_below"))
    t = targets(cells.groupBy(F.col("mix_source").alias("source")).agg(F.sum(F.col("mix_size") * F.col("mix_n")).alias("source_size")), weights, share, most)
    step = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")) * UNIT), F.lit(0)).cast("long")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).cast("binary")), 1, 6), 16, 10).cast("long")
    t = t.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_total"), F.col("target").alias("mix_target"), step.alias("mix_step"), start.alias("mix_start"))
    in_size = Window.partitionBy("mix_source", "mix_size").orderBy("mix_bucket").rowsBetween(*up_to)
    cells = cells.withColumn("mix_here", F.coalesce(F.sum("mix_n").over(in_size), F.lit(0)))
    same = lambda a, b, *names: [a[x].eqNullSafe(b[x]) for x in names]
    cells = cells.join(of_size, same(cells, of_size, "mix_source", "mix_size")).drop(of_size.mix_source).drop(of_size.mix_size)
    cells = cells.join(t, same(cells, t, "mix_source")).drop(t.mix_source)
    cells = cells.select("mix_source", "mix_size", "mix_bucket", (F.col("mix_below") + F.col("mix_here")).alias("mix_first"), "mix_total", "mix_target", "mix_step", "mix_start")
    row = F.row_number().over(Window.partitionBy("mix_source", "mix_size", "mix_bucket").orderBy("doc_id"))
    d = d.withColumn("mix_row", row)
    d = d.join(cells, same(d, cells, "mix_source", "mix_size", "mix_bucket")).drop(cells.mix_source).drop(cells.mix_size).drop(cells.mix_bucket)
    i = F.col("mix_first") + F.col("mix_row")
    crossed = F.shiftright(F.col("mix_start") + i * F.col("mix_step"), 24) - F.shiftright(F.col("mix_start") + (i - 1) * F.col("mix_step"), 24)
    return d.select(*shown, F.col("mix_total").alias("source_size"), F.col("mix_target").alias("target"), crossed.cast("long").alias("copies"))
