"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Null ids sort after every integer.
NULL_ID = np.iinfo(np.int64).max


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local session gets a temporary one, a cluster an error: a folder of one machine is none that executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="panelwright-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders that cut() made while scratch() is open.
_made: list[str] | None = None


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete the intermediate tables of what is called and written inside, once it is written."""
    global _made
    before, _made = _made, []
    try:
        yield
    finally:
        for path in _made:
            _delete(spark, path)
        _made = before


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df in the shared folder and read it back: the lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = path or temporary(spark, "cut")
    # The write's shuffle files go with it: nothing runs this plan again.
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; scratch() deletes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _made is not None:
        _made.append(path)
    return path


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, file)


def column(name: str) -> Column:
    """The column of that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def passed(df: DataFrame, *outputs: str) -> list[Column]:
    """df's columns that no output replaces: an output takes the place of an input column of its name."""
    taken = {o.lower() for o in outputs}
    return [column(c) for c in df.columns if c.lower() not in taken]


def masked(df: DataFrame, *outputs: str) -> tuple[list[Column], list[Column]]:
    """(df's columns that no output replaces under plain names, the same columns back under their own), so that an operator's own names can't clash with them."""
    names = [c for c in df.columns if c.lower() not in {o.lower() for o in outputs}]
    return [column(c).alias(f"mix_c{i}") for i, c in enumerate(names)], [F.col(f"mix_c{i}").alias(c) for i, c in enumerate(names)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels may not be learned from; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the five ASCII control spaces; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column as one flat array; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def slices(offsets: np.ndarray, size: int):
    """Cut documents into runs [a, b) of about `size` bytes, one document at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = b


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a long, b long), any order, repeats and loops allowed. Returns (id, component) for every id
    that has an edge to another id; component is the smallest id that it reaches. Each round is two
    groupings by id with partial aggregation; its result is written to the shared folder. An id with very
    many links is only ever reduced to a minimum before its links are joined to that, and AQE splits that
    join. It ends when each component is a star. No links reach the driver; it sees whether a round is the last.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        if large:  # neighbours above the node move to the least of the node and its neighbours
            low = low.select("u", F.least("m", "u").alias("m"))
            return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        moved = both.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def settled(e: DataFrame) -> bool:
        """Only stars are left: no id points to two others, or is pointed to and points on."""
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()

    rounds = 0
    while not settled(e):
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        after = cut(star(star(e, True), False))
        discard(e)
        e, rounds = after, rounds + 1
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the links (i, j) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
