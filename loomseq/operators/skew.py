"""Look-ups under skew (JOIN4): one key may hold most rows of the left side.

A key with more than 1/share of the rows is hot, and there are fewer than `share` of these, whatever the
table; so what the right side has for them is broadcast with a proven bound. All other keys are joined by
shuffle, where none has more than 1/share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 256


def hot_keys(left: DataFrame, keys: list[str], share: int = SHARE) -> DataFrame:
    """(keys...) that hold more than 1/share of left's rows: fewer than share of them. Counts are added up
    before the shuffle."""
    total = left.agg(F.count(F.lit(1)).alias("_all"))
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") * share > F.col("_all")).select(*keys)  # one row


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", share: int = SHARE) -> DataFrame:
    """left.join(right, keys, how) for how = left or inner, where right has at most a row for each key. Left is
    read three times, so give a written table where it is dear. Null keys match nothing and are never shuffled."""
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    hot = hot_keys(left, keys, share)
    heads = right.join(F.broadcast(hot), keys, "left_semi")
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    marked = left.join(mark, keys, "left").withColumn("_hot", F.coalesce("_hot", ~present))
    some = marked.where("_hot").drop("_hot").join(F.broadcast(heads), keys, how)
    rest = marked.where("not _hot").drop("_hot").join(right, keys, how)
    return rest.unionByName(some)
