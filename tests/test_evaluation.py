"""History by split, metrics seen in passing, k-mer cache, dense padding, ranks, whole vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomseq.operators import attention, metrics, ragged
from loomseq.sources import kmer_cache
from loomseq.streaming import history

SCHEMA = "split string, epoch int, step bigint, f1 double"


def table(spark, folder):
    rows = history.read(spark, folder, spark.createDataFrame([], SCHEMA)).collect()
    return sorted(map(tuple, rows))


def test_history_keeps_splits_apart_and_replays(spark, tmp_path):
    at = str(tmp_path / "h")
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    one = batch(("dev", 1, 10, 0.5), ("dev", 1, 12, 0.6), ("dev", 2, 20, 0.7))
    history.upsert(one, at)
    want = [("dev", 1, 12, 0.6), ("dev", 2, 20, 0.7)]
    assert table(spark, at) == want
    history.upsert(one, at)
    assert table(spark, at) == want  # a replayed batch
    history.upsert(batch(("dev", 1, 11, 0.1)), at)
    assert table(spark, at) == want  # a late one
    history.upsert(batch(("test", 2, 21, 0.9)), at)
    assert table(spark, at) == [*want, ("test", 2, 21, 0.9)]  # Q12: the last epoch stays
    history.upsert(batch(("dev", 2, 25, 0.8)), at)
    assert table(spark, at) == [want[0], ("dev", 2, 25, 0.8), ("test", 2, 21, 0.9)]


def test_history_of_a_stream(spark, tmp_path):
    src, at = str(tmp_path / "src"), str(tmp_path / "h")
    stream = lambda: history.keep(spark.readStream.schema(SCHEMA).parquet(src), at, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("dev", 1, 1, 0.5)], SCHEMA).write.mode("append").parquet(src)
    stream()
    spark.createDataFrame([("dev", 1, 2, 0.6), ("test", 1, 2, 0.4)], SCHEMA).write.mode("append").parquet(src)
    stream()
    assert table(spark, at) == [("dev", 1, 2, 0.6), ("test", 1, 2, 0.4)]


def test_observed_metrics_like_the_table(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([0, 1, 2, 3, -100]), rng.choice([0, 1, 2, 4])) for _ in range(300)]
    for data in (rows, [(1, 1)], [(-100, 0)]):
        df = spark.createDataFrame(data, "label int, pred int")
        watch = metrics.Watched(5)
        watch.rows(df, "label", "pred").write.mode("overwrite").parquet(str(tmp_path / "out"))
        got = watch.result()
        want = metrics.scores(metrics.confusion(df.where("label <> -100"))).collect()
        for name, value in got.items():
            assert math.isclose(value, (want[0][name] if want and want[0][name] is not None else 0.0), abs_tol=1e-12), name


def test_kmer_cache_sees_changed_files(spark, tmp_path):
    src, cache = tmp_path / "src", str(tmp_path / "cache")
    src.mkdir()

    def put(name, *seqs):
        spark.createDataFrame([(s,) for s in seqs], "seq string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "one"))
        part = next((tmp_path / "one").glob("part-*.parquet"))
        (src / name).write_bytes(part.read_bytes())

    def get(k=3):
        df, done = kmer_cache.kmers_of(spark, spark.read.parquet(str(src)), "seq", k, cache)
        return sorted(r.seq for r in df.collect()), [p.rsplit("/", 1)[1] for p in done]

    for n, s in (("a.parquet", "ACGT"), ("b.parquet", "TTT"), ("c.parquet", "GG")):
        put(n, s)
    assert get() == (["", "ACG CGT", "TTT"], ["a.parquet", "b.parquet", "c.parquet"])
    assert get() == (["", "ACG CGT", "TTT"], [])
    put("b.parquet", "CCCC", "AAA")
    assert get() == (["", "AAA", "ACG CGT", "CCC CCC"], ["b.parquet"])
    assert get(2)[1] == ["a.parquet", "b.parquet", "c.parquet"]
    (src / "a.parquet").unlink()
    assert get() == (["", "AAA", "CCC CCC"], [])


def test_dense_padding(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 2, 6), (1, 9, 7), (2, 1, 8), (2, 1, 4), (3, -1, 1)], "k int, pos int, v int")
    keys = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,)], "k int")
    got = sorted(map(tuple, ragged.pad_dense(rows, keys, ["k"], "pos", "v", 4, F.lit(0)).collect()))
    assert got == [(1, [5, 0, 6, 0]), (2, [0, 4, 0, 0]), (2, [0, 4, 0, 0]), (3, [0] * 4), (4, [0] * 4)]
    plan = ragged.pad_dense(rows, keys, ["k"], "pos", "v", 4, F.lit(0))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_ranks_and_places(spark):
    df = spark.createDataFrame([([1, 0, 1, 1, 0], [0, 1, 1, 0, 0]), ([], []), ([0, 0], [1, 1]), ([1, 1], [1, 1])], "o array<int>, i array<int>")
    got = df.select(ragged.ranks(F.col("o")), ragged.selects(F.col("o")), ragged.subset_of_subset(F.col("o"), F.col("i"))).collect()
    assert [tuple(r) for r in got] == [([0, 1, 1, 2, 3], [0, 2, 3], [1]), ([], [], []), ([0, 0], [], []), ([0, 1], [0, 1], [0, 1])]
    assert [r.k for r in ragged.head_rows(spark.createDataFrame([(3,), (1,), (2,)], "k int"), ["k"], 2).collect()] == [1, 2]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_attention_in_blocks(spark, block):
    rng = random.Random(block)
    vec = lambda scale: [rng.gauss(0, scale) for _ in range(3)]
    rows = [(s, p, vec(30), vec(30), vec(1)) for s, n in ((1, 7), (2, 1), (3, 4)) for p in range(n)]
    df = spark.createDataFrame(rows, "s int, p int, q array<double>, k array<double>, v array<double>").repartition(3)
    got = {(r.s, r.qpos): r.value for r in attention.attend(df, "s", "p", "q", "k", "v", 3, 0.5, block).collect()}
    assert len(got) == len(rows)
    for s, p, q, _, _ in rows:
        own = [r for r in rows if r[0] == s]
        score = [sum(a * b for a, b in zip(q, r[3])) / math.sqrt(3) - 0.5 * abs(r[1] - p) for r in own]
        w = [math.exp(x - max(score)) for x in score]
        want = [sum(a * r[4][d] for a, r in zip(w, own)) / sum(w) for d in range(3)]
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[s, p], want))


def test_vector_sums_and_fusion(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 2.0), (1, [3.0, 4.0], 0.5), (2, [5.0, 6.0], 1.0)], "k int, v array<double>, w double")
    assert sorted(map(tuple, attention.vector_sum(df, ["k"], "v", 2).collect())) == [(1, [4.0, 6.0]), (2, [5.0, 6.0])]
    assert sorted(map(tuple, attention.vector_sum(df, ["k"], "v", 2, F.col("w")).collect())) == [(1, [3.5, 6.0]), (2, [5.0, 6.0])]
    plan = attention.vector_sum(df, ["k"], "v", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "partial_sum" in plan
    tokens = spark.createDataFrame([(1, 0, [1.0, 1.0]), (1, 1, [2.0, 2.0])], "doc_id int, pos int, v array<double>")
    inc = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "doc_id int, rk int, pos int")
    grams = spark.createDataFrame([(1, 1, [10.0, 0.0]), (1, 2, [0.0, 20.0])], "doc_id int, rk int, v array<double>")
    assert sorted(map(tuple, attention.fuse_vectors(tokens, inc, grams, 2).collect())) == [(1, 0, [1.0, 1.0]), (1, 1, [12.0, 22.0])]


def test_embedding_of_a_hot_id(spark):
    ids = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(600)], "row int, id int")
    names = spark.createDataFrame([(i, [float(i)]) for i in range(600)], "id int, vector array<double>")
    got = attention.embed(ids, names, F.array(F.lit(0.5))).collect()
    assert sorted((r.row, r.vector[0]) for r in got) == [(i, (0 if i % 3 else i) + 0.5) for i in range(600)]
