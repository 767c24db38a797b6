"""What is made from a row alone in Arrow batches, against expressions and loops."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq.functions.tokens import stable_partition
from loomseq.functions.vectors import alibi_slopes
from loomseq.operators import encoder, masking, model

RECORD = "doc_id string, input_ids array<int>, ngrams array<struct<id:int,pos:array<int>>>, other int"


def some_records(spark):
    r = random.Random(8)
    rows = [(None, [2, 9, 8, 3], [(7, [1, 2])], 0), ("none", [2, 3], [], 1), ("null", None, [], 2), ("empty", [], [(5, [1])], 3)]
    for k in range(60):
        ids = [2, *(r.randrange(1, 30) for _ in range(r.randrange(40))), 3, *[0] * r.randrange(3)]
        grams = [(r.randrange(6), sorted(r.sample(range(1, 45), r.randrange(1, 5)))) for _ in range(r.randrange(8))]
        rows.append((f"d{k}", ids, grams, k))
    return spark.createDataFrame(rows, RECORD).repartition(3)


def by_expressions(records, whole, rate):
    """mask_record() as expressions over arrays, each looked at for itself."""
    row, live = F.col("doc_id"), F.filter("ngrams", lambda g: g["id"] != 0)
    out = records.withColumn("cand", masking.candidates(F.col("input_ids"), row, [2, 3, 0], rate, 3))
    out = out.withColumn("fold", masking.closure(F.col("cand"), live)).localCheckpoint()
    cand = F.array_sort("fold.cand") if whole else F.col("cand").cast("array<int>")
    gone = F.struct(F.lit(0).alias("id"), F.array().cast("array<int>").alias("pos"))
    left = stable_partition(F.transform("ngrams", lambda g: F.when(F.array_contains("fold.removed", g["id"]), gone).otherwise(g)), lambda g: g["id"] == 0)
    new = masking.masked_ids(F.col("input_ids"), cand, row, 4, 50, 3)
    return out.select("doc_id", "other", new.alias("input_ids"), (left if whole else F.col("ngrams")).alias("ngrams"), cand.alias("candidates"), masking.labels_of(F.col("input_ids"), cand).alias("labels"))


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0])
def test_rows_are_masked_as_expressions_mask_them(spark, whole, rate):
    records = some_records(spark)
    got = masking.mask_record(records, "doc_id", [2, 3, 0], 4, 50, rate, whole, seed=3)
    cols = ["doc_id", "other", "input_ids", "ngrams", "candidates", "labels"]
    assert sorted(got.columns) == sorted(cols) and "lambdafunction" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, by_expressions(records, whole, rate).collect()))
    one = masking.mask_record(records, "doc_id", [2, 3, 0], 4, 50, rate, whole, seed=3, made=("labels",))
    assert "input_ids" not in one.columns and sorted(map(str, one.select("labels").collect())) == sorted(map(str, got.select("labels").collect()))


def peak_mb(run):
    run()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_losses_hold_few_scores_and_logits():
    """500 masked tokens against 4,096 ids: before, all their logits at once (16 MB, three times) and all scores of all heads."""
    m = model.Model.fixed(4096, 40, 8, 16, 2, 2, 1, 2, 5)
    ids = np.random.default_rng(1).permutation(4000)[:512] + 5
    made = m.hidden(ids, np.ones(512), [(3, [4, 5])], np.arange(1, 501))
    predicted, losses = model._losses(m, made, ids[1:501])
    z = m.token_logits(made)
    assert predicted == z.argmax(1).tolist()
    assert losses == pytest.approx((np.log(np.exp(z).sum(1)) - z[np.arange(500), ids[1:501]]).tolist(), abs=1e-12)
    m.decoder_bias[7] = 900.0  # exponentials of such logits need the shift by their maximum
    z = m.token_logits(made)
    assert model._losses(m, made, ids[1:501])[1] == pytest.approx((z[:, 7] - z[np.arange(500), ids[1:501]]).tolist())
    assert peak_mb(lambda: model._losses(m, made, ids[1:501])) < 5
    assert peak_mb(lambda: m.hidden(ids, np.ones(512), [(3, [4, 5])])) < 6


@pytest.mark.parametrize("size", [0.1, 30.0])  # 30: exponentials of these scores need the shift by their maximum
@pytest.mark.parametrize("hidden_rows", [0, 3])
def test_attention_in_blocks_of_queries(size, hidden_rows):
    """Against all scores at once; rows of a kind, a subset, and keys that are hidden."""
    r = np.random.default_rng(2)
    kinds = r.permutation(np.arange(150) % 40)
    qkv = r.normal(0, size, (40, 24))[kinds]
    mask = (np.arange(150) < 150 - hidden_rows).astype(float)
    at = np.array([0, 3, 77, 149])
    for distance in (True, False):
        q, k, v = (y.reshape(150, 2, 4).transpose(1, 0, 2) for y in np.split(qkv, 3, axis=1))
        s = q @ k.transpose(0, 2, 1) / 2 + (1 - mask) * -10000.0
        if distance:
            s = s - np.array(alibi_slopes(2))[:, None, None] * np.abs(np.arange(150)[:, None] - np.arange(150))
        p = np.exp(s - s.max(-1, keepdims=True))
        want = ((p / p.sum(-1, keepdims=True)) @ v).transpose(1, 0, 2).reshape(150, 8)
        for rows in (np.arange(150), at):
            for alike in (None, kinds):
                assert encoder.attend(rows, qkv, 2, mask, distance, alike) == pytest.approx(want[rows], abs=1e-9 * size)
        assert encoder.attend(slice(None), qkv, 2, mask, distance, kinds) == pytest.approx(want, abs=1e-9 * size)


def test_classifier_makes_the_first_position_alone(spark, monkeypatch):
    m = model.Model.fixed(50, 9, 8, 6, 2, 2, 1, 3, 1)
    ids, grams = [2, 7, 9, 7, 3, 0], [{"id": 4, "pos": [1, 2]}]
    rows = [(1, ids, [1, 1, 1, 1, 1, 0], grams), (2, ids, [0, 1, 1, 1, 1, 0], grams), (3, [], [], [])]
    df = spark.createDataFrame(rows, "doc_id int, input_ids array<int>, attention_mask array<int>, ngrams array<struct<id:int,pos:array<int>>>")
    got = {r.doc_id: r.logits for r in model.classify(df, m).collect()}
    whole = m.classify(m.hidden(ids, rows[0][2], [(4, [1, 2])]))
    unseen = m.classify(np.zeros((1, 8)))
    assert got[1] == pytest.approx(whole.tolist()) and got[2] == pytest.approx(unseen.tolist()) == got[3]
    seen = []
    monkeypatch.setattr(encoder, "attend", lambda *a, inner=encoder.attend: seen.append(len(out := inner(*a))) or out)
    run, _ = model.classified(m)({"doc_id": "int"})
    run(df.where("doc_id = 1").toArrow().to_batches()[0])
    assert seen == [5, 1, 1]  # the tokens, their n-gram, and the first position


def test_loss_positions_pass_once_and_unshuffled(spark):
    """One pass in Python, of which labels alone come back, and a compiled filter of their rows."""
    from loomseq.queries import QUERIES

    p = QUERIES["mlm_positions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert p.count("MapInArrow") == 1 and "lambdafunction" not in p and "input_ids" not in p


def test_places_in_a_subset_without_a_list_of_ranks(spark):
    from loomseq.operators import ragged

    r = random.Random(4)
    rows = [([1, 1, 0, 1], [0, 1, 1, 1]), ([], []), ([0], [1]), ([1, 0, 1], [1]), ([1], [1, 1]), (None, [1]), ([1], None)]
    rows += [([r.randrange(2) for _ in range(50)], [r.randrange(2) for _ in range(50)]) for _ in range(20)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, o array<int>, i array<int>")
    got = df.select("k", ragged.subset_of_subset(F.col("o"), F.col("i")).alias("p"))
    for k, p in got.collect():
        o, i = rows[k]
        places = None if o is None or i is None else [sum(o[:j]) for j in range(min(len(o), len(i))) if o[j] == i[j] == 1]
        assert p == places
    assert "array_append" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("repeated", [False, True])
def test_whole_vectors_are_fused_by_rows(spark, repeated, monkeypatch):
    """What fuse_positions() gives of matched n-grams and their vectors, without a shuffle of either."""
    from loomseq.operators import attention
    from loomseq.plans import records as rec

    monkeypatch.setattr(attention, "PAIRS", 7)
    docs = [(k // 2 if repeated else k, " ".join(random.Random(k).choices("abcd", k=k % 9))) for k in range(60)] + [(99, None), (98, "")]
    texts = spark.createDataFrame(docs, "doc_id bigint, tokens string")
    known = spark.createDataFrame([("a b", 1), ("b a", 2), ("b a c", 2), ("c d", 3), ("d d", 4), ("c c", 5)], "ngram string, ngram_id int")
    shape, keys = rec.Shape(8, 2, 3, 2), texts.select("doc_id")
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -4.0]), (1, [2.0, 0.25]), (2, [None, 3.0]), (3, None), (7, [9.0, 9.0])], "id bigint, v array<double>")
    sent = spark.sparkContext.broadcast(attention.table_of(vectors, "id", "v", 2, 5))
    step = attention.fused(sent, lambda ids: ids - 1, {"one": np.array([1.0, 0.0]), "both": np.array([1.0, 10.0])})
    got = rec.matched_lists(texts, keys, known, shape, then=(step,))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == repeated
    grams = rec.matched(texts, keys, known, shape).withColumn("id", F.col("ngram_id") - 1).join(vectors, "id")
    want = attention.fuse_positions(grams, 2)
    zero = lambda x: 0.0 if x is None else x
    expected = sorted((r.doc_id, r.pos, *((None, None) if r.v == [None, None] else (zero(r.v[0]), zero(r.v[0]) + 10 * zero(r.v[1])))) for r in want.collect())
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 50 and any(x[2] is None for x in expected)
    with pytest.raises(ValueError):
        attention.table_of(vectors, "id", "v", 2, 3)


def test_no_vectors_and_no_ngrams(spark):
    from loomseq.operators import attention, batches

    none = spark.createDataFrame([], "id bigint, v array<double>")
    step = attention.fused(spark.sparkContext.broadcast(attention.table_of(none, "id", "v", 2, 5)), lambda ids: ids, {"one": np.ones(2)})
    rows = spark.createDataFrame([(1, [(3, [1, 2])]), (2, []), (3, None)], "doc_id bigint, ngrams array<struct<id:int,pos:array<int>>>")
    assert batches.over(rows, step).collect() == []
    assert batches.over(rows.where("doc_id = 2"), step).collect() == []
