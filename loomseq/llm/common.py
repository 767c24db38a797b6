"""Shared parts: scratch tables, held-out rows, Arrow batches, connected components."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a session names no checkpoint folder, and only then (tests, single machine).
LOCAL_SCRATCH = "/tmp/checkpoints/loomseq"
_made: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, which all executors and the driver see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    return LOCAL_SCRATCH


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation. The table goes when the driver ends."""
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The table that materialise() gives, and its folder."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/loomseq-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_drop_all)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def settled(make) -> tuple[DataFrame, str]:
    """What make() gives, written, and its folder; tables that were written on the way go."""
    before = len(_made)
    out, path = written(make())
    for spark, p in _made[before:]:
        if p != path:
            drop_scratch(spark, p)
    _made[before:] = [x for x in _made[before:] if x[1] == path]
    return out, path


def drop_scratch(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for spark, path in _made:
        try:
            drop_scratch(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows whose crc32 of doc_id as text has this remainder; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def map_batches(df: DataFrame, fn, schema, rows: int = 256) -> DataFrame:
    """mapInArrow with fn from RecordBatch to RecordBatch, dict of columns, or an iterable of these.

    fn sees at most `rows` rows at a time, so that a worker never holds a whole Arrow batch of texts
    as Python objects."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches):
        for whole in batches:
            for c in range(0, whole.num_rows, rows):
                out = fn(whole.slice(c, rows))
                for x in [out] if isinstance(out, (dict, pa.RecordBatch)) else out:
                    yield as_batch(x, target)
            whole = out = x = None
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Memory that Arrow and malloc hold in reserve goes back to the system. A worker outlives its tasks,
    and several of a stage's workers stand beside those of the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def as_batch(x, target: pa.Schema) -> pa.RecordBatch:
    cols = []
    for f in target:
        c = x[f.name] if isinstance(x, dict) else x.column(f.name)
        if not isinstance(c, (pa.Array, pa.ChunkedArray)):
            c = pa.array(c, type=f.type)
        cols.append(c if c.type == f.type else c.cast(f.type))
    return pa.RecordBatch.from_arrays(cols, schema=target)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's bytes; a null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def named_rows(docs: DataFrame) -> DataFrame:
    """docs with a hash of the whole row."""
    return docs.withColumn("_row", F.xxhash64(*[x for c in docs.columns for x in (F.isnull(F.col(f"`{c}`")), F.col(f"`{c}`"))]))


def unused(taken: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that no taken column has, whatever its case."""
    seen, out = {c.lower() for c in taken}, []
    for w in wanted:
        while w.lower() in seen:
            w = "_" + w
        seen.add(w.lower())
        out.append(w)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in the (a, b) edges: root is the smallest id reachable.

    Alternating large-star and small-star steps; each works on rows of edges with partial
    aggregation, so a hub never meets in one task, and the links stay distributed. Every round is
    written to the shared folder, and rounds grow with the logarithm of a component's diameter."""
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, path, mark = _round(start)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        before = path
        now, path, after = _round(small)
        drop_scratch(edges.sparkSession, before)  # nothing reads an older round again
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    return roots.unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())


def _round(df: DataFrame):
    """The written table, its folder, and a mark of its rows: their number and two sums of hashes."""
    t, path = written(df)
    h = F.xxhash64("hi", "lo")
    row = t.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))), F.sum(F.shiftrightunsigned(h, 24))).head()
    return t, path, tuple(row)
