"""Two-level scans and look-ups under skew, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from loomseq.operators import ragged, scan, skew


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_prefix_sums_of_a_wide_table(spark, reuse):
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        n = 3_000_000
        wide = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), (F.col("id") % 97).alias("n"), F.md5(F.col("id").cast("string")).alias("extra"))
        got = ragged.cu_seqlens(wide, "k", shards=64).agg(F.max(F.col("cu_start") + F.col("n")), F.count_distinct("cu_start", "k"), F.sum("cu_start")).head()
        sizes = [0] * n
        for i in range(n):
            sizes[(i * 7919) % n] = i % 97
        at = total = 0
        for s in sizes:
            total += at
            at += s
        assert tuple(got) == (at, n, total)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


@pytest.mark.parametrize("shards", [1, 5, 23])
@pytest.mark.parametrize("inclusive", [False, True])
def test_prefix_sums_by_group(spark, shards, inclusive):
    rng = random.Random(shards)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), k, rng.choice([1, 2, None]), rng.randrange(4)) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, k int, a int, b int").repartition(3)
    got = scan.prefix_sums(df, ["k"], {"sa": "a", "sb": "b"}, by=["g"], inclusive=inclusive, shards=shards)
    assert got.columns == ["g", "k", "a", "b", "sa", "sb"]
    want, seen = [], {}
    for g, k, a, b in rows:
        sa, sb = seen.get(g, (0, 0))
        now = (sa + (a or 0), sb + b)
        want.append((g, k, a, b, *(now if inclusive else (sa, sb))))
        seen[g] = now
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_hot_group_is_cut(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("g"), "id", F.lit(1).alias("one"))
    table = scan.dealt(df, ["g", "id"], shards=16)
    assert table.groupBy("_shard").count().agg(F.max("count")).head()[0] < 4_000
    assert scan.bases(table, ["g"], {"s": "one"}).count() <= 16


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "k int, n int, x string")
    assert ragged.cu_seqlens(df, "k").collect() == []
    assert scan.prefix_sums(df, ["k"], {"s": "n"}, by=["x"]).collect() == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_under_skew(spark, how):
    rng = random.Random(3)
    keys = [1] * 500 + [2] * 300 + [None] * 50 + [rng.randrange(3, 400) for _ in range(700)]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    right = spark.createDataFrame([(k, k * 10) for k in range(1, 300)], "k int, v int")
    got = skew.lookup(left, right, ["k"], how, share=8)
    want = [(k, i, k * 10 if k and k < 300 else None) for i, k in enumerate(keys)]
    want = [w for w in want if how == "left" or w[2] is not None]
    assert sorted(map(tuple, got.select("k", "i", "v").collect()), key=str) == sorted(want, key=str)
    assert sorted(r.k for r in skew.hot_keys(left.where("k is not null"), ["k"], 8).collect()) == [1, 2]


def test_hot_keys_are_few(spark):
    left = spark.range(3000).select((F.col("id") % 40).alias("k"))
    assert skew.hot_keys(left, ["k"], 32).count() == 0 and skew.hot_keys(left, ["k"], 64).count() == 40
