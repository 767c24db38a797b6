"""Labelled sequence CSV (SRC1-SRC3, SRC6, KMR1).

A file has a header, whose names are ignored, and two columns (sequence, label) or three
(seq_a, seq_b, label). Quoting follows RFC 4180, as Python's csv module reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.functions.sequence import kmer_str

#: Column names by the number of columns.
LAYOUTS = {2: ["sequence", "label"], 3: ["seq_a", "seq_b", "label"]}
SPLITS = ("train", "dev", "test")


def _raw(spark: SparkSession, path: str, names: list[str] | None) -> DataFrame:
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .option("emptyValue", "")
        .option("nullValue", "\u0000")
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
    )
    if names:
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return reader.csv(path)


def read_labelled(spark: SparkSession, path: str, kmer: int = -1) -> DataFrame:
    """Read one file. The first row's arity decides the layout; other arities raise ValueError.

    Labels are cast with ANSI rules, so a label that isn't an integer fails the job. kmer > 0
    replaces each sequence by its k-mer string, in pairs each sequence by itself.
    """
    arity = len(_raw(spark, path, None).columns)
    if arity not in LAYOUTS:
        raise ValueError(f"unsupported format: {arity} columns, expected 2 or 3")
    names = LAYOUTS[arity]
    df = _raw(spark, path, names).withColumn("label", F.col("label").cast("int"))
    return with_kmers(df, names[:-1], kmer) if kmer > 0 else df


def with_kmers(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Replace the named sequence columns by their k-mer strings."""
    return df.withColumns({c: kmer_str(F.col(c), k) for c in columns})


def read_splits(spark: SparkSession, folder: str, kmer: dict[str, int] | None = None) -> DataFrame:
    """train.csv, dev.csv and test.csv as one frame with a split column; kmer is given by split."""
    kmer = kmer or {}
    parts = [
        read_labelled(spark, f"{folder}/{s}.csv", kmer.get(s, -1)).withColumn("split", F.lit(s)) for s in SPLITS
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sequences_of(df: DataFrame) -> Column:
    """The sequence columns of either layout as one array, which pair tokenisation concatenates."""
    return F.array(*[F.col(c) for c in df.columns if c in ("sequence", "seq_a", "seq_b")])


def cached_kmers(spark: SparkSession, df: DataFrame, path: str, columns: list[str], k: int, refresh: bool = False) -> DataFrame:
    """K-mers kept as Parquet at path, keyed by k; refresh writes them anew."""
    target = f"{path}/k={k}"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(target)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    if refresh or not there:
        with_kmers(df, columns, k).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
