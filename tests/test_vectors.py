import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq.functions import vectors as vec
from loomseq.operators import attention, encoder, metrics, ragged
from loomseq.sources import metrics_json


def test_metrics_fixture(spark, tmp_path):
    y, p = [0, 0, 1, 1, 2, -100], [0, 1, 1, 1, 0, 2]
    rows = [(a, [1.0 if i == b else 0.0 for i in range(3)]) for a, b in zip(y, p)]
    df = spark.createDataFrame(rows, "label int, logits array<double>")
    s = metrics.scores(metrics.confusion(metrics.predictions(df, "logits", "label")))
    r = s.head()
    want = (0.6, 0.433333, 0.360844, 0.388889, 0.5)
    assert [round(x, 6) for x in r] == list(want)
    assert json.load(open(metrics_json.write_final(s, str(tmp_path))))["accuracy"] == 0.6
    h = metrics.history(s.crossJoin(spark.range(3)).selectExpr("*", "'epoch_1' as epoch_key", "id as step").drop("id"))
    assert list(json.load(open(metrics_json.write_history(h, str(tmp_path))))) == ["epoch_1"]


def test_metrics_one_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, pred int")
    r = metrics.scores(metrics.confusion(df)).head()
    assert r.matthews_correlation == 0 and r.f1 == 1


def test_flatten_and_argmax(spark):
    df = spark.createDataFrame([([[0.0, 2.0], [3.0, 3.0]], [1, -100])], "logits array<array<double>>, label array<int>")
    flat = metrics.flatten_logits(df, "logits", "label")
    assert sorted((r.label, r.pred) for r in metrics.predictions(flat, "logits", "label").collect()) == [(1, 1)]
    assert flat.select(vec.argmax(F.col("logits"))).collect()[1][0] == 0


def test_ragged(spark):
    c = spark.createDataFrame([(0, 3), (1, 1), (2, 2)], "k bigint, n bigint")
    assert [r.cu_start for r in ragged.cu_seqlens(c, "k", shards=2).orderBy("k").collect()] == [0, 3, 4]
    r = random.Random(2)
    many = spark.createDataFrame([(i, r.randint(0, 9)) for i in range(500)], "k bigint, n bigint")
    rows, at = ragged.cu_seqlens(many, "k", shards=7).orderBy("k").collect(), 0
    for x in rows:
        assert x.cu_start == at
        at += x.n
    rows = spark.createDataFrame([(0, 0, 7, 1), (0, 1, 8, 1), (0, 2, 0, 0), (1, 0, 9, 1), (1, 1, 0, 0), (1, 2, 0, 0)], "k int, pos int, v int, mask int")
    packed = ragged.unpad(rows)
    assert ragged.lengths(rows, "k").orderBy("k").collect()[0].n == 2
    back = ragged.pad(packed, rows, "k", "pos", "v", 3, F.lit(0)).orderBy("k", "pos")
    assert [x.v for x in back.collect()] == [7, 8, 0, 9, 0, 0]


def test_slopes():
    assert vec.alibi_slopes(8) == [2.0**-i for i in range(1, 9)]
    assert vec.alibi_slopes(12) == pytest.approx([2.0**-i for i in range(1, 9)] + [2**-0.5, 2**-1.5, 2**-2.5, 2**-3.5])
    assert vec.alibi_slopes(16) == pytest.approx([2 ** (-0.5 * i) for i in range(1, 17)])


def test_vector_expressions(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=12)
    df = spark.createDataFrame([(v.tolist(), 3)], "v array<double>, i int")
    row = df.select(vec.softmax(F.col("v")).alias("s"), vec.layer_norm(F.col("v")).alias("n"), vec.log_softmax_at(F.col("v"), F.col("i")).alias("l")).head()
    e = np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    assert row.s == pytest.approx(e) and row.n == pytest.approx((v - v.mean()) / v.std()) and row.l == pytest.approx(math.log(e[3]))
    g = spark.createDataFrame([(float(x),) for x in v], "x double").select(vec.gelu("x").alias("y")).collect()
    assert [x.y for x in g] == pytest.approx(encoder.gelu(v))
    for name, f in vec.ACTIVATIONS.items():
        assert df.select(f(F.get("v", F.lit(0)))).count() == 1, name


def test_attention_and_fusion(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(5, 4))
    rows = spark.createDataFrame([(0, i, x[i].tolist()) for i in range(5)], "s int, pos int, v array<double>")
    w = attention.weights(attention.scores(rows, "s", "pos", "v", "v", 4, 0.5), "s")
    s = x @ x.T / 2 - 0.5 * np.abs(np.subtract.outer(range(5), range(5)))
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert all(a.weight == pytest.approx(p[a.qpos, a.kpos]) for a in w.collect())
    out = attention.weighted_values(w, rows, "s", "pos", "v").collect()
    assert all(a.value == pytest.approx((p @ x)[a.qpos, a.dim]) for a in out)
    tok = spark.createDataFrame([(0, 1, 0, 1.0), (0, 2, 0, 2.0)], "doc_id int, pos int, dim int, value double")
    inc = spark.createDataFrame([(0, 1, 2), (0, 2, 2)], "doc_id int, rk int, pos int")
    g = spark.createDataFrame([(0, 1, 0, 10.0), (0, 2, 0, 5.0)], "doc_id int, rk int, dim int, value double")
    assert sorted(a.value for a in attention.fuse(tok, inc, g).collect()) == [1.0, 17.0]


def test_encoder_matches_numpy(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(4, 8))
    w = [encoder.BlockWeights.fixed(8, 16, 2, 1)]
    rows = spark.createDataFrame([(0, i, x[i].tolist(), int(i < 3)) for i in range(4)], "s int, pos int, v array<double>, m int")
    got = {a.pos: a.v for a in encoder.encode(rows, "s", "pos", "v", w, "m").collect()}
    want = encoder.block(x[:3], np.ones(3), w[0])
    assert all(got[i] == pytest.approx(want[i]) for i in range(3)) and got[3] == pytest.approx(x[3])
    padded = encoder.block(x, np.array([1.0, 1, 1, 0]), w[0])
    assert padded[:3] == pytest.approx(want)


def test_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1, 0.5, 1.0), ([0.0, -1.0], 0, -30.0, 0.0)], "v array<double>, y int, x double, t double")
    r = df.agg(attention.cross_entropy(F.col("v"), F.col("y")).alias("a"), attention.mse(F.col("x"), F.col("t")).alias("b"), attention.bce_with_logits(F.col("x"), F.col("t")).alias("c")).head()
    assert r.a == pytest.approx(math.log(1 + math.exp(-1))) and r.b == pytest.approx((0.25 + 900) / 2)
    assert r.c == pytest.approx((math.log1p(math.exp(-0.5)) + math.log1p(math.exp(-30))) / 2)
    assert attention.problem_type(1, "double") == "regression" and attention.problem_type(3, "int").startswith("single")


def test_erf():
    import math

    from loomseq.functions.vectors import erf

    x = np.concatenate([np.linspace(-8, 8, 4001), [0.0, 1e-9, 40.0, -40.0]])
    assert np.abs(erf(x) - [math.erf(v) for v in x]).max() < 1e-14


def slow_block(x, w, slopes, gated):
    """Row by row and head by head."""
    n, d = x.shape
    size = d // w.heads
    qkv = [[sum(x[i][a] * w.wqkv[a][b] for a in range(d)) + w.bqkv[b] for b in range(3 * d)] for i in range(n)]
    mixed = np.zeros((n, d))
    for h in range(w.heads):
        q, k, v = (np.array([r[s * d + h * size : s * d + (h + 1) * size] for r in qkv]) for s in range(3))
        for i in range(n):
            e = np.array([np.exp(q[i] @ k[j] / size**0.5 - slopes[h] * abs(i - j)) for j in range(n)])
            mixed[i, h * size : (h + 1) * size] = sum(e[j] * v[j] for j in range(n)) / e.sum()

    def scaled(y, s):
        return (y - y.mean()) / np.sqrt(y.var() + 1e-12) * s[0] + s[1]

    import math

    act = lambda v: np.array([0.5 * a * (1 + math.erf(a / 2**0.5)) for a in v])
    out = []
    for i in range(n):
        y = scaled(mixed[i] @ w.wo + w.bo + x[i], w.norm1)
        z = (act((y @ w.gated)[: len(w.down)]) * (y @ w.gated)[len(w.down) :]) if gated else act(y @ w.up + w.bup)
        out.append(scaled(z @ w.down + w.bdown + y, w.norm2))
    return np.array(out)


def test_model_with_fusion(spark):
    """Biases, norms, fusion, padding, the subset path and both heads against loops."""
    from loomseq.functions.vectors import alibi_slopes
    from loomseq.operators import model

    m = model.Model.fixed(20, 9, 8, 6, 2, 2, 1, 3, 1)
    ids, mask = [2, 7, 9, 11, 3, 0, 0], [1, 1, 1, 1, 1, 0, 0]
    grams = [(4, [1, 2]), (2, [2, 3])]
    x = m.embed(np.array(ids[:5]))
    g = slow_block(m.embed_grams(np.array([4, 2])), m.gram_layers[0], [0, 0], False)
    x = slow_block(x, m.layers[0], alibi_slopes(2), True)
    for k, (_, at) in enumerate(grams):
        for p in at:
            x[p] = x[p] + g[k]
    x = slow_block(x, m.layers[1], alibi_slopes(2), True)
    got = m.hidden(ids, mask, grams)
    assert got[:5] == pytest.approx(x, abs=1e-9) and (got[5:] == 0).all()
    assert m.hidden(ids, mask, grams, np.array([0, 3])) == pytest.approx(x[[0, 3]], abs=1e-9)
    zero = m.embed_grams(np.array([0]))
    m.gram_table[0] += 5
    assert (m.embed_grams(np.array([0])) == zero).all()  # the padding id has no vector
    rows = [(1, ids, mask, [{"id": a, "pos": b} for a, b in grams], [-100, 7, -100, 5, -100, -100, -100]), (2, [2, 3], [1, 1], [], [-100, -100])]
    df = spark.createDataFrame(rows, "doc_id int, input_ids array<int>, attention_mask array<int>, ngrams array<struct<id:int,pos:array<int>>>, labels array<int>")
    logits = {r.doc_id: r.logits for r in model.classify(df, m).collect()}
    want = np.tanh(x[0] @ m.pooler[0] + m.pooler[1]) @ m.classifier[0] + m.classifier[1]
    assert logits[1] == pytest.approx(want.tolist()) and len(logits[2]) == 3
    one, none = sorted(model.masked_tokens(df, m).collect())
    z = m.token_logits(x[[1, 3]])
    loss = [float(np.log(np.exp(a).sum()) - a[y]) for a, y in zip(z, (7, 5))]
    assert one.positions == [1, 3] and one.predicted == z.argmax(1).tolist() and one.losses == pytest.approx(loss)
    assert (none.positions, none.predicted, none.losses) == ([], [], [])
