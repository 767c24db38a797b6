"""CSV records of large files (SRC1-SRC3): one file is read by many tasks, and rows that don't fit are kept apart.

Files are read as lines, which Spark splits at any line feed, also one inside a quoted field. Whether a line begins
inside a field follows from the number of quotes before it in its file: an odd one says yes. A task doesn't know
that number, so it counts the records of its part of a file for both cases at once, in one pass without a shuffle.
What stands before a part then follows from one row for each part. A record of one line, as nearly all
are, is never shuffled; the lines of longer ones are, once.

Quoting is that of RFC 4180: a quote stands around a field or, doubled, inside a quoted one. Line ends are LF or CR LF,
both read as LF. A record whose quotes stand elsewhere is reported, and so may be those after it in its file, as what
a stray quote begins is anyone's guess. A record of several lines is at most max_record characters long; a
longer one (a quote that nothing closes) is reported by its first line, and isn't gathered."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseq.plans.scratch import fixed
from loomseq.sources.labelled_csv import LAYOUTS, SPLITS, with_kmers

MAX_RECORD = 1 << 20
QUOTED = '"[^"]*"'
#: n numbers a part's lines; odd and before are parities of quotes, in the line and in the part before it; r0 and d0 are the
#: records begun in the part and the characters of the last one (of all lines, if none began) up to and with the
#: line, if the part doesn't begin inside a field, and r1 and d1 if it does.
COUNTED = "file string, at bigint, line string, n bigint, odd int, before int, size bigint, r0 bigint, r1 bigint, d0 bigint, d1 bigint"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, line): at is the start of the task's part of the file."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))


def _count(batches: Iterable[pa.RecordBatch]):
    """Lines with COUNTED's numbers. A task reads each of its parts in one go and in the order of its lines."""
    part, n, quotes, records, since = None, 0, 0, [0, 0], [0, 0]
    for b in batches:
        rows = b.num_rows
        if not rows:
            continue
        files, at = b.column("file").dictionary_encode(), np.asarray(b.column("at"))
        code, odd, size = np.asarray(files.indices), np.asarray(b.column("odd")), np.asarray(b.column("size"))
        edges = np.flatnonzero((code[1:] != code[:-1]) | (at[1:] != at[:-1])) + 1
        nth, before = np.empty(rows, np.int64), np.empty(rows, np.int32)
        r, d = np.empty((2, rows), np.int64), np.empty((2, rows), np.int64)
        for s, e in zip([0, *edges], [*edges, rows]):
            here = files.dictionary[code[s]].as_py(), at[s]
            if here != part:
                part, n, quotes, records, since = here, 0, 0, [0, 0], [0, 0]
            nth[s:e] = n + np.arange(e - s)
            total = quotes + np.cumsum(odd[s:e])
            before[s:e] = (total - odd[s:e]) % 2
            sums = np.cumsum(size[s:e])
            for k in (0, 1):
                starts = before[s:e] == k
                r[k, s:e] = records[k] + np.cumsum(starts)
                last = np.maximum.accumulate(np.where(starts, np.arange(e - s), -1))
                d[k, s:e] = sums + np.where(last < 0, since[k], -(sums - size[s:e])[last])
                records[k], since[k] = int(r[k, e - 1]), int(d[k, e - 1])
            n, quotes = n + e - s, int(total[-1]) % 2
        own = [nth, odd, before, size, *r, *d]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("file", "at", "line")), *map(pa.array, own)], names=["file", "at", "line", "n", "odd", "before", "size", "r0", "r1", "d0", "d1"])


def _before(counted: DataFrame) -> DataFrame:
    """(file, at, inside, past, carry) for each part but a file's first: whether it begins inside a field, the records begun before
    it, and the characters that its first record has there. The windows see a row for each part."""
    ends = counted.groupBy("file", "at").agg(F.max(F.struct("n", "odd", "before", "r0", "r1", "d0", "d1")).alias("z")).select("file", "at", "z.*")
    order = Window.partitionBy("file").orderBy("at")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("odd") + F.col("before")).over(earlier) % 2, F.lit(0)).cast("int")
    chosen = ends.select("file", "at", inside.alias("inside")).alias("p").join(ends.alias("e"), ["file", "at"])
    pick = lambda c: F.when(F.col("inside") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    own = chosen.select("file", "at", "inside", pick("r").alias("r"), pick("d").alias("d"))
    open_ = own.withColumn("era", F.sum((F.col("r") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto = open_.withColumn("upto", F.sum("d").over(Window.partitionBy("file", "era").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    return upto.select("file", "at", "inside", F.sum("r").over(earlier).alias("past"), F.lag("upto").over(order).alias("carry")).where("at > 0")


def records(spark: SparkSession, path: str | list[str], max_record: int = MAX_RECORD) -> DataFrame:
    """(file, record, raw, problem): records numbered from 1 within their file."""
    odd = (F.length(F.regexp_replace("line", '[^"]+', "")) % 2).cast("int").alias("odd")
    size = (F.length("line") + 1).cast("bigint").alias("size")
    # Read anew for either kind of record: the numbers depend on the files and their parts alone, and no table is written.
    counted = lines(spark, path).select("*", odd, size).mapInArrow(_count, COUNTED)
    zero = F.lit(0)
    named = counted.join(fixed(_before(counted)), ["file", "at"], "left").withColumn("inside", F.coalesce("inside", zero))
    pick = lambda c: F.when(F.col("inside") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    named = named.withColumns({
        "starts": F.col("before") == F.col("inside"), "record": pick("r") + F.coalesce("past", zero),
        "upto": pick("d") + F.when(pick("r") == 0, F.coalesce("carry", zero)).otherwise(zero),
    })
    none = F.lit(None).cast("string")
    alone = named.where("starts and odd = 0").select("file", "record", F.col("line").alias("raw"), none.alias("problem"))
    # Lines that begin past the bound aren't gathered, so a record's group is bounded; one line past it tells of the others.
    parts = named.where("not (starts and odd = 0)").where(F.col("starts") | (F.col("upto") - F.col("size") <= max_record))
    over = F.col("upto") > max_record
    kept = parts.select("file", "record", "at", "n", over.alias("over"), F.when(F.col("starts") | ~over, F.col("line")).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "n", "line")))["line"]
    grouped = kept.groupBy("file", "record").agg(F.max("over").alias("over"), ordered.alias("z"))
    raw = F.when(F.col("over"), F.col("z")[0]).otherwise(F.array_join("z", "\n"))
    joined = grouped.select("file", "record", raw.alias("raw"), F.when(F.col("over"), F.lit("record too long")).alias("problem"))
    return alone.unionByName(joined)


def n_fields(raw: Column) -> Column:
    return F.size(F.split(F.regexp_replace(raw, QUOTED, ""), ","))


def bad_quotes(raw: Column) -> Column:
    """A quoted part beside anything but a comma or an end, or a quote without its partner."""
    marked = F.regexp_replace(F.regexp_replace(raw, "\u0001", ""), QUOTED, "\u0001")
    return F.contains(marked, F.lit('"')) | marked.rlike("[^,\u0001]\u0001|\u0001[^,\u0001]")


def read_labelled(spark: SparkSession, path: str | list[str], kmer: int = -1, max_record: int = MAX_RECORD) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, sequence columns..., label) and errors (file, record, raw, problem) of labelled sequences.

    Every file's first record is a header, whose names are ignored. The first row after it decides between two
    columns and three; other numbers raise ValueError, as do files that differ and files without a row. Later
    rows may have more fields, which are ignored; one with fewer, with stray quotes or with a label that isn't
    an integer of 32 bits is an error. Empty lines are skipped. row_id rises with file and record."""
    found = records(spark, path, max_record).where("record > 1 and raw <> ''").withColumn("fields", n_fields(F.col("raw")))
    first = found.groupBy("file").agg(F.min_by("fields", "record").alias("fields")).groupBy("fields").agg(F.count(F.lit(1))).limit(2).collect()
    if len(first) != 1 or first[0].fields not in LAYOUTS:
        raise ValueError(f"unsupported format: {sorted(r.fields for r in first)} columns, expected 2 or 3")
    names = LAYOUTS[first[0].fields]
    options = {"escape": '"', "quote": '"', "emptyValue": "", "nullValue": "\u0000"}
    parsed = F.from_csv("raw", ", ".join(f"{n} string" for n in names), options)
    problem = F.coalesce(
        "problem", F.when(bad_quotes(F.col("raw")), "stray quote"), F.when(F.col("fields") < len(names), "too few fields"),
        F.when(F.col("number").isNull(), "label is not an integer"),
    )
    text = F.regexp_replace(F.col("z.label"), r"^\s+|\s+$", "")
    rows = found.withColumn("z", parsed).withColumn("number", F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))).withColumn("problem", problem)
    row_id = F.struct("file", "record").alias("row_id")
    good = rows.where("problem is null").select(row_id, *[F.coalesce(f"z.{n}", F.lit("")).alias(n) for n in names[:-1]], F.col("number").alias("label"))
    bad = rows.where("problem is not null").select("file", "record", "raw", "problem")
    return with_kmers(good, names[:-1], kmer) if kmer > 0 else good, bad


def read_splits(spark: SparkSession, folder: str, kmer: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """train.csv, dev.csv and test.csv: rows and errors, each with a split column; kmer is given by split."""
    kmer = kmer or {}
    both = [tuple(x.withColumn("split", F.lit(s)) for x in read_labelled(spark, f"{folder}/{s}.csv", kmer.get(s, -1))) for s in SPLITS]
    good, bad = both[0]
    for g, b in both[1:]:
        good, bad = good.unionByName(g), bad.unionByName(b)
    return good, bad
