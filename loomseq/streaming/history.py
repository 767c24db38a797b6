"""History of evaluations by (split, epoch), kept up by a stream or by batches (MET2, SNK2).

The table has a folder for each split and epoch with the one evaluation that has the highest step. A batch
touches its own folders alone: what is there and what comes are merged, and each folder is overwritten as a whole.
So a batch that is replayed, after a lost driver for example, changes nothing, a late one with a lower step changes
nothing either, and an evaluation of the test split never touches an epoch of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.plans.scratch import fixed

KEYS = ["split", "epoch"]


def latest(evaluations: DataFrame, order: str = "step") -> DataFrame:
    """Of each split and epoch the evaluation with the highest step; of several, the greatest by its values."""
    rest = [c for c in evaluations.columns if c not in (*KEYS, order)]
    top = evaluations.groupBy(*KEYS).agg(F.max(F.struct(order, *rest)).alias("_e"))
    return top.select(*KEYS, *[F.col(f"_e.{c}").alias(c) for c in (order, *rest)])


def read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The table, or an empty frame with like's columns."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(folder).select(*like.columns)


def upsert(evaluations: DataFrame, folder: str, order: str = "step") -> None:
    """Merge evaluations (split, epoch, step, metrics...) into the table at folder."""
    spark = evaluations.sparkSession
    coming = fixed(latest(evaluations, order))
    there = read(spark, folder, coming).join(F.broadcast(coming.select(*KEYS)), KEYS, "left_semi")
    merged = fixed(latest(there.unionByName(coming), order))  # a table can't be overwritten while it is read
    merged.write.partitionBy(*KEYS).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)


def keep(evaluations: DataFrame, folder: str, checkpoint: str, order: str = "step"):
    """Start a stream that merges every batch of evaluations into the table. Returns the query."""
    stream = evaluations.writeStream.option("checkpointLocation", checkpoint)
    return stream.foreachBatch(lambda batch, _: upsert(batch, folder, order)).trigger(availableNow=True).start()
