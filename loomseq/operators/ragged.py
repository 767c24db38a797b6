"""Ragged and dense sequences (JOIN7-8, WIN1, AGG9-10, FLT8-11). Rows keyed by (key, pos) stand for
packed tensors, so unpadding is a filter and padding a left join from the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.functions.vectors import let
from loomseq.operators.scan import prefix_sums


def unpad(rows: DataFrame, mask: str = "mask") -> DataFrame:
    """Keep rows whose mask is 1."""
    return rows.where(F.col(mask) == 1)


def lengths(rows: DataFrame, key: str, mask: str = "mask") -> DataFrame:
    return rows.groupBy(key).agg(F.sum(F.col(mask).cast("bigint")).alias("n"))


def cu_seqlens(counts: DataFrame, key: str, n: str = "n", shards: int | None = None) -> DataFrame:
    """Exclusive prefix sum of n in key order, as cu_start beside all columns of counts; other columns decide
    among rows that share a key. No task sees all rows, see scan.py."""
    others = [c for c in counts.columns if c not in (key, n)]
    tie = counts.withColumn("_tie", F.xxhash64(*others) if others else F.lit(0))
    return prefix_sums(tie, [key, n, "_tie"], {"cu_start": n}, shards=shards).drop("_tie")


def pad(rows: DataFrame, keys: DataFrame, key: str, pos: str, value: str, seq_length: int, fill) -> DataFrame:
    """Every (key, 0..seq_length-1) with the row's value, or fill where there is none."""
    grid = keys.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(seq_length - 1))).alias(pos))
    return grid.join(rows.select(key, pos, value), [key, pos], "left").withColumn(value, F.coalesce(value, fill))


def pad_dense(rows: DataFrame, keys: DataFrame, key: list[str], pos: str, value: str, seq_length: int, fill) -> DataFrame:
    """(key..., value): one array of seq_length values for each row of keys, fill where rows has none (JOIN8).

    A key's rows are gathered by one shuffle and sorted, and the gaps between them are filled; there is no grid to join,
    and no look-up for each place. Keys that are repeated in keys stay apart, and each gets the key's values; of rows that
    share a position the least value counts. Positions from seq_length on are left out."""
    inside = rows.where((F.col(pos) >= 0) & (F.col(pos) < seq_length) & F.col(value).isNotNull())
    entry = F.struct(F.col(pos).cast("int").alias("p"), F.col(value).alias("v"))
    sparse = inside.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    before = lambda e, i: F.coalesce(F.get(e, i - 1)["p"], F.lit(-1))
    met = keys.select(*key).join(sparse, key, "left")
    met = met.withColumn("_e", F.explode(F.array(F.filter("_e", lambda x, i: x["p"] != before(F.col("_e"), i)))))  # made once
    gaps = F.transform("_e", lambda x, i: F.concat(F.array_repeat(fill, x["p"] - before(F.col("_e"), i) - 1), F.array(x["v"])))
    last = F.coalesce(F.get("_e", F.size("_e") - 1)["p"], F.lit(-1))
    dense = F.concat(F.coalesce(F.flatten(gaps), F.array().cast(f"array<{dict(rows.dtypes)[value]}>")), F.array_repeat(fill, seq_length - 1 - last))
    return met.select(*key, dense.alias(value))


def ranks(mask: Column) -> Column:
    """For each place of a 0/1 array the number of ones before it: where a row of the whole stands in the subset."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    step = lambda a, m: F.struct((a["n"] + (m == 1).cast("int")).alias("n"), F.array_append(a["out"], a["n"]).alias("out"))
    return F.aggregate(mask, start, step)["out"]


def selects(mask: Column) -> Column:
    """The places of the ones, in order: where a row of the subset stands in the whole."""
    places = F.transform(mask, lambda m, i: F.when(m == 1, i))
    return F.filter(places, lambda p: p.isNotNull())


def subset_of_subset(outer: Column, inner: Column) -> Column:
    """Both masks are over the whole array, and the inner one's rows are wanted by their places among the outer one's
    (FLT11): a model that keeps only the outer rows finds its inner ones there. Inner rows that the outer mask
    leaves out have no place.

    The outer ones' places are listed in order, so the number of a place in that list is its rank, and no list of ranks is
    made, which ranks() copies for each place."""
    wanted = let(inner, lambda y: F.transform(selects(outer), lambda i, k: F.when(F.get(y, i) == 1, k)))
    return F.when(inner.isNotNull(), F.filter(wanted, lambda k: k.isNotNull()))


def head_rows(rows: DataFrame, order: list[str], n: int = 16) -> DataFrame:
    """The first n rows, for a look at the data (ARR13)."""
    return rows.orderBy(*order).limit(n)


def loss_positions(rows: DataFrame, label: str = "label") -> DataFrame:
    """Positions with a label over 0: id 0 and the ignore value both drop out."""
    return rows.where(F.col(label) > 0)


def subset(rows: DataFrame, masked: str, pos: str = "pos") -> DataFrame:
    """Masked positions and the first of each sequence."""
    return rows.where(F.col(masked) | (F.col(pos) == 0))


def pool_first(rows: DataFrame, pos: str = "pos") -> DataFrame:
    return rows.where(F.col(pos) == 0)
