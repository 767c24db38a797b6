"""Pruned counts, matching by rows, dense padding: against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomseq.functions import draws
from loomseq.operators import attention, masking, ngrams, ragged
from loomseq.plans import records as rec


def rows(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, tokens array<string>")


def counted(docs, low, high, least, size):
    c = Counter(" ".join(t for t in d[s : s + n] if t is not None) for d in docs for n in range(low, high + 1) for s in range(len(d) - n + 1))
    return sorted(((g, n) for g, n in c.items() if n >= least), key=lambda x: (-x[1], x[0]))[:size]


CASES = {
    "few": ([list("abcab"), ["x"], [], list("ab")], 2, 50),
    "many": ([random.Random(k).choices("abcdefgh", k=30) for k in range(80)], 2, 40),
    "ties": ([[f"{k}a", f"{k}b", f"{k}c"] for k in range(60)] * 3, 2, 20),
    "blanks": ([["a b", "c"], ["a", "b c"], ["a", "b", "c"], ["a", None, "b"], ["a", "b"]], 2, 5),
}


@pytest.mark.parametrize("name", CASES)
def test_dictionary_against_loops(spark, name):
    """Also where most counts are alike, and where different windows give one string."""
    docs, least, size = CASES[name]
    got = ngrams.top_counts(rows(spark, docs), "tokens", 2, 4, least, size).collect()
    assert sorted((r.ngram, r.n) for r in got) == sorted(counted(docs, 2, 4, least, size))


def test_dictionary_shuffles_only_likely_windows(spark):
    """Neighbours that occur once take no part in the counts by string."""
    docs = [[f"{k}-{i}" for i in range(40)] + ["a", "b", "c"] for k in range(20)]
    tokens = rows(spark, docs)
    pairs = ngrams._pair_counts(tokens, "tokens").where("n >= 5").toPandas()
    made = ngrams._likely_counts(tokens, "tokens", 2, 5, pairs.bucket.to_numpy())
    assert {(r.ngram, r.n) for r in made.collect()} == {("a b", 20), ("b c", 20), ("a b c", 20)}


def test_dictionary_shuffles_only_the_fullest_windows(spark):
    """Windows of likely neighbours that are rarer than the wanted ones take no part in the counts by string."""
    docs = [["a", "b", "c"]] * 9 + [["b", "c", "d"]] * 6 + [["a", "b"]] * 2
    pairs = ngrams._pair_counts(rows(spark, docs), "tokens", 5).toPandas()
    assert sorted(pairs.n) == [6, 11, 15]
    own, least = ngrams._fullest(ngrams._window_counts(rows(spark, docs), "tokens", 2, 3, pairs.bucket.to_numpy(), 5), 3, 5)
    assert (len(own), least) == (3, 7)
    made = ngrams._likely_counts(rows(spark, docs), "tokens", 2, 3, pairs.bucket.to_numpy(), own)
    assert {(r.ngram, r.n) for r in made.collect()} == {("b c", 15), ("a b", 11), ("a b c", 9)}


def test_bucket_counts_meet_packed(spark, monkeypatch):
    """A task sends a row for each range of buckets, not for each bucket, also where it has to send more than once."""
    monkeypatch.setattr(ngrams, "GATHERED", 64)
    r = random.Random(4)
    docs = [[f"t{int(r.expovariate(0.02))}" for _ in range(60)] for _ in range(2500)]
    out = ngrams._pair_counts(rows(spark, docs).repartition(2), "tokens")
    assert "range#" in out._jdf.queryExecution().executedPlan().toString()
    want = Counter(p for d in docs for p in zip(d, d[1:]))
    assert sorted(x.n for x in out.collect()) == sorted(want.values())
    assert sorted(x.n for x in ngrams._pair_counts(rows(spark, docs), "tokens", 3).collect()) == sorted(n for n in want.values() if n > 2)


def test_only_small_tables_are_dealt_anew(spark):
    """A table that Spark cuts into a part for each core is read as it is; its texts were shuffled before."""
    from loomseq import queries

    cores = spark.sparkContext.defaultParallelism
    plan = lambda n: queries.spread(spark.range(0, 1000, 1, n))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(cores) and ("Exchange" in plan(cores - 1) if cores > 1 else True)


def test_records_are_not_shuffled(spark):
    docs = rows(spark, [list("abab"), list("ba"), [], ["[PAD]", "a", "b"]] * 30)
    known = spark.createDataFrame([("a b", 1), ("b a", 2), ("b a", 3)], "ngram string, ngram_id int")
    vocab = spark.createDataFrame([("a", 5)], "token string, id int")
    out = rec.records(docs, vocab, known, rec.Shape(8, 2, 3, 30))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].input_ids == [2, 5, 1, 5, 1, 3, 0, 0] and got[3].attention_mask == [1, 0, 1, 1, 1, 0, 0, 0]
    assert {(g.id, *g.pos) for g in got[0].ngrams} == {(1, 1, 2, 3, 4), (2, 2, 3), (3, 2, 3)}
    assert got[0].ngrams[0].id == 1 and got[2].ngrams == [] and [g.id for g in got[3].ngrams] == [1]


def test_split_is_the_pattern(spark):
    texts = [None, "", "  a\x1cb\x85c d e ", "​zero width", *("".join(random.Random(k).choices("ab \t\x0b\x1f　 ﻿", k=40)) for k in range(50))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    other = rec.tokenised(df, tokenizer=lambda t: rec.words(t))
    assert sorted(map(str, rec.tokenised(df).collect())) == sorted(map(str, other.collect()))


def test_pad_dense_shuffles_once(spark):
    keys = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    r = spark.createDataFrame([(1, 2, 9), (1, 2, 7), (1, 0, 5), (1, 3, None), (1, 9, 1), (3, 3, 4)], "k int, pos bigint, id int")
    got = ragged.pad_dense(r, keys, ["k"], "pos", "id", 4, F.lit(0))
    assert sorted((x.k, x.id) for x in got.collect()) == [(1, [5, 0, 7, 0]), (1, [5, 0, 7, 0]), (2, [0, 0, 0, 0]), (3, [0, 0, 0, 4])]
    assert "map_from_entries" not in got._jdf.queryExecution().analyzed().toString()


def test_type_vector_is_added_to_the_table(spark):
    ids = spark.createDataFrame([(k, k % 3) for k in range(9)], "doc_id int, id int")
    table = spark.createDataFrame([(k, [float(k)] * 2) for k in range(3)], "id int, vector array<double>")
    for bound in (None, 3):
        got = attention.embed(ids, table, F.array_repeat(F.lit(0.5), 2), table_rows=bound).collect()
        assert {(r.doc_id, *r.vector) for r in got} == {(k, k % 3 + 0.5, k % 3 + 0.5) for k in range(9)}


@pytest.mark.parametrize("repeated", [False, True])
def test_matches_are_made_by_rows(spark, repeated):
    """Tokens are shuffled only where rows that share a key have to meet; either way it is what match() gives."""
    docs = [(k // 2 if repeated else k, " ".join(random.Random(k).choices("abcd", k=k % 9))) for k in range(60)] + [(99, None), (98, "")]
    texts = spark.createDataFrame(docs, "doc_id bigint, tokens string")
    known = spark.createDataFrame([("a b", 1), ("b a", 2), ("b a c", 2), ("c d", 3), ("d d", 4)], "ngram string, ngram_id int")
    shape = rec.Shape(8, 2, 3, 2)
    got = rec.matched(texts, texts.select("doc_id"), known, shape)
    assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == repeated
    cut = texts.selectExpr("doc_id", "slice(filter(split(tokens, ' '), t -> t <> ''), 1, 6) tokens")
    want = ngrams.match(cut, "tokens", known, 2, 3, 2, 8, dictionary_rows=5)
    rows_of = lambda d: sorted((r.doc_id, r.ngram_id, *r.positions, r.rk) for r in d.collect())
    assert rows_of(got) == rows_of(want) and len(rows_of(want)) > 20


def test_texts_are_split_where_they_are_looked_at(spark):
    """Texts and arrays of their words give the same records, vocabulary and dictionary."""
    texts = [None, "", "a\x1cb\u3000c a b", " [PAD] a b ", *(" ".join(random.Random(k).choices("abcdef", k=30)) for k in range(40))]
    raw = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, tokens string")
    split = rec.tokenised(raw, "tokens")
    out = []
    for docs in (raw, split):
        vocab, known = rec.corpus_tokens(docs), ngrams.corpus_dictionary(docs, "tokens", 2, 3, 2, 30)
        out.append([sorted(map(str, d.collect())) for d in (vocab, known, rec.records(docs, vocab, known, rec.Shape(12, 2, 3, 5)), ngrams.windows(docs, "tokens", 2, 3))])
    assert out[0] == out[1]


def test_masks_need_no_vocabulary(spark):
    docs = rows(spark, [list("abab"), [], ["[PAD]", "a"], list("abcdefgh")])
    vocab = spark.createDataFrame([("a", 5)], "token string, id int")
    want = rec.token_half(docs, vocab, rec.Shape(6)).select("doc_id", "attention_mask")
    assert sorted(map(str, rec.masks(docs, rec.Shape(6)).collect())) == sorted(map(str, want.collect()))


def test_candidate_rows_are_the_candidates(spark):
    """Positions drawn row by row, by digits, are those drawn from the array, by numbers; padding never is."""
    half = spark.createDataFrame([(k, [2, *range(5, 45), 3, 0, 0]) for k in range(30)], "doc_id bigint, ids array<int>")
    for rate in (0.0, 0.15, 0.5, 1.0):
        got = masking.candidate_rows(half, "ids", "doc_id", [0, 2, 3], rate, 7)
        assert "ArrayFilter" not in got._jdf.queryExecution().optimizedPlan().toString() and "filter(" not in got._jdf.queryExecution().optimizedPlan().toString()
        u = half.select("doc_id", F.posexplode("ids").alias("pos", "t")).where(~F.col("t").isin(0, 2, 3) & (draws.uniform(7, F.col("doc_id"), F.col("pos"), "select") < rate))
        old = half.select("doc_id", F.explode(masking.candidates(F.col("ids"), F.col("doc_id"), [0, 2, 3], rate, 7)).alias("pos"))
        rows_of = lambda d: sorted((r.doc_id, r.pos) for r in d.collect())
        assert rows_of(got) == rows_of(u) == rows_of(old)


def test_fused_positions_meet_no_incidence(spark):
    """Sums by position are those of fuse_vectors(), without a join of n-grams and the places that they cover."""
    grams = spark.createDataFrame([(d, k, [k, k + 1, 2 * k], [float(k), d + 0.5]) for d in range(5) for k in range(1, 6)], "doc_id bigint, rk int, positions array<int>, v array<double>")
    got = attention.fuse_positions(grams, 2)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    inc = ngrams.matrix_rows(grams)
    zeros = inc.select("doc_id", "pos").distinct().withColumn("v", F.array(F.lit(0.0), F.lit(0.0)))
    want = attention.fuse_vectors(zeros, inc, grams.select("doc_id", "rk", "v"), 2)
    rows_of = lambda d: sorted((r.doc_id, r.pos, *r.v) for r in d.collect())
    assert rows_of(got) == rows_of(want)
