"""K-mers of files, kept as Parquet and made anew where a file has changed (SRC6, KMR1).

A file's key is its path, size and time of change, as Spark's scan reports them. The cache has a folder for each k
and key; files whose key isn't there are read, in one job, and those that are gone or changed aren't read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions.sequence import kmer_str


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def content_keys(files: DataFrame) -> DataFrame:
    """(path, key) of every file that a frame read from files scans; no row's data is read."""
    meta = files.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    key = F.md5(F.concat_ws("|", "file_path", "file_size", F.unix_micros("file_modification_time")))
    return meta.groupBy("file_path").agg(F.max("file_size").alias("file_size"), F.max("file_modification_time").alias("file_modification_time")).select("file_path", key.alias("key"))


def kmers_of(spark: SparkSession, files: DataFrame, column: str, k: int, cache: str) -> tuple[DataFrame, list[str]]:
    """(every column of files, with `column` as its k-mers) and the paths that were computed, the rest being kept.

    files: a frame straight from a file source, such as spark.read.parquet(folder); Spark plans a file at least as
    a task, so the driver's list of files is one that it holds anyhow."""
    at = f"{cache.rstrip('/')}/k={k}"
    keys = {r.file_path: r.key for r in content_keys(files).collect()}
    stale = sorted(p for p, key in keys.items() if not _exists(spark, f"{at}/key={key}/_DONE"))
    if stale:
        todo = spark.createDataFrame([(p, keys[p]) for p in stale], "_path string, key string")
        rows = files.withColumn("_path", F.col("_metadata.file_path")).join(F.broadcast(todo), "_path").drop("_path")
        # Each key's folder is overwritten, so that what a lost run left there doesn't stay.
        rows.withColumn(column, kmer_str(F.col(column), k)).write.partitionBy("key").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(at)
        for p in stale:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/key={keys[p]}/_DONE")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()
    if not keys:
        return files.withColumn(column, kmer_str(F.col(column), k)), stale
    own = spark.read.schema(files.schema).parquet(*[f"{at}/key={key}" for key in sorted(keys.values()) if _exists(spark, f"{at}/key={key}")])
    return own, stale
