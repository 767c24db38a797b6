"""Tables written to the folder that the cluster shares: they fix once what several plans read, cut the
lineage, and survive lost executors."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Only where a local session names no checkpoint folder (tests, single machine).
LOCAL_FOLDER = "/tmp/checkpoints/loomseq"
_written: list[tuple[SparkSession, str]] = []


def folder_of(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    return (named or LOCAL_FOLDER).rstrip("/")


def new_folder(spark: SparkSession, kind: str = "fixed") -> str:
    """A path that nothing has, in the shared folder; what is written there goes when the driver ends."""
    path = f"{folder_of(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop)
    _written.append((spark, path))
    return path


def fixed(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read back. The table goes when the driver ends."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether Spark drops an execution's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fixed_alone(df: DataFrame) -> DataFrame:
    """As fixed(); what this write shuffled goes from the disk when it is done. No other plan reads its shuffles."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return fixed(df)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


def give_back() -> None:
    """Memory that Arrow and malloc hold in reserve goes back to the system, as a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def _drop() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            return
