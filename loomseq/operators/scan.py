"""Prefix sums over an order of all rows, in two levels (WIN1).

Rows are dealt by ranges of (group, order) and written once, each with the number of its range, the shard.
So bounds are data: whatever reads the table later, and however often, sees the same shards. Shards hold
about the same number of rows, also where one group has most of them. Within a shard a window adds up;
what stands before a shard is known from one row for each shard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.plans.scratch import fixed

SHARD = "_shard"


def dealt(df: DataFrame, keys: list, name: str = SHARD, shards: int | None = None) -> DataFrame:
    """df by ranges of keys with the number of the range, written. Rows with equal keys share a shard; the
    numbers rise with the keys, nulls first. Without a number of shards adaptive execution sets it by size."""
    ranges = df.repartitionByRange(shards, *keys) if shards else df.repartitionByRange(*keys)
    return fixed(ranges.withColumn(name, F.spark_partition_id()))


def bases(table: DataFrame, by: list[str], sums: dict[str, str], name: str = SHARD) -> DataFrame:
    """(shard, by..., sums...): what a group has in earlier shards, for groups that began in one.

    Only the first group of a shard can have begun before it, so this has at most a row for each shard. Sums
    are added up before they are shuffled."""
    pieces = table.groupBy(name, *by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    if by:
        edge = table.groupBy(name).agg(F.min(F.struct(*by)).alias("_lo"), F.max(F.struct(*by)).alias("_hi"))
        own = F.struct(*by)
        pieces = pieces.join(F.broadcast(edge), name).where(own.eqNullSafe(F.col("_lo")) | own.eqNullSafe(F.col("_hi")))
    before = Window.partitionBy(*by).orderBy(name)  # at most two rows a shard, one without groups
    past = [F.sum(n).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n in sums]
    return pieces.select(name, *by, F.row_number().over(before).alias("_nth"), *past).where("_nth > 1").drop("_nth")


def with_bases(table: DataFrame, base: DataFrame, by: list[str], sums: list[str], name: str = SHARD) -> DataFrame:
    """table with the base's sums as _base_<name>, 0 where a group began in the row's own shard. The base has
    a row for each shard at most, and is broadcast."""
    renamed = base.select(F.col(name).alias("_s"), *[F.col(c).alias(f"_by_{c}") for c in by], *[F.col(n).alias(f"_base_{n}") for n in sums])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col(name) == F.col("_s"))
    out = table.join(F.broadcast(renamed), on, "left").drop("_s", *[f"_by_{c}" for c in by])
    return out.withColumns({f"_base_{n}": F.coalesce(f"_base_{n}", F.lit(0)) for n in sums})


def scanned(table: DataFrame, order: list[str], sums: dict[str, str], by: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """What prefix_sums() gives, of a table that dealt() made for (by, order), and with its shards; columns may have
    been added since, so that one deal serves several scans of which one needs another's sums."""
    by = by or []
    within = Window.partitionBy(SHARD, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = {n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}
    out = with_bases(table.withColumns(local), bases(table, by, sums), by, list(sums))
    return out.withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in sums}).drop(*[f"_base_{n}" for n in sums])


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], by: list[str] | None = None, inclusive: bool = False, shards: int | None = None) -> DataFrame:
    """df with, for each (new: column) of sums, the column's sum over the rows of the same group that stand
    before the row in the given order, and over the row itself if inclusive. Nulls add nothing.

    Rows with equal (by, order) get sums in any order among them; give a full order where this matters.
    Column names with a leading underscore are taken."""
    return scanned(dealt(df, [*(by or []), *order], shards=shards), order, sums, by, inclusive).drop(SHARD)
