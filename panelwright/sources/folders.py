"""Where intermediate and result tables go: the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local session gets a temporary one; a cluster gets an error, as a folder of one machine is none that executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="panelwright-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


#: What panels are written under. Shuffle files go as soon as the result stands, not when the driver happens to collect
#: its garbage; Arrow batches of numbers are bounded by their rows, as their bytes would be added up anew for each row.
EAGER = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}


@contextlib.contextmanager
def eager(spark: SparkSession):
    """Jobs that are run inside run under EAGER; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in EAGER}
    for k, v in EAGER.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, folder: str) -> DataFrame:
    """df of a panel, written there once and read from there; the shuffles that made it are gone."""
    with eager(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
