import random

from pyspark.sql import functions as F

from loomseq.operators import masking, ngrams
from loomseq.plans import records as rec

SMALL = rec.Shape(max_seq_length=8, low=2, high=3, cap=4)
VOCAB = {"A B": 5, "A B A": 7, "B A": 9}


def model(tokens, vocab, shape):
    """Plain loops over windows."""
    tokens, pos, first = tokens[: shape.max_seq_length - 2], {}, {}
    for s in range(len(tokens)):
        for n in range(shape.low, shape.high + 1):
            g = " ".join(tokens[s : s + n])
            if s + n <= len(tokens) and g in vocab:
                pos.setdefault(vocab[g], set()).update(range(s + 1, s + n + 1))
                first.setdefault(vocab[g], (s, n))
    ids = sorted(pos, key=first.get)[: shape.cap]
    return [(i, sorted(pos[i])) for i in ids]


def build(spark, docs, vocab, shape):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, tokens array<string>")
    toks = sorted({t for x in docs for t in x})
    v = spark.createDataFrame([(t, i + 5) for i, t in enumerate(toks)] or [("x", 5)], "token string, id int")
    return rec.records(d, v, spark.createDataFrame(list(vocab.items()), "ngram string, ngram_id int"), shape)


def test_record_fixture(spark):
    r = rec.dense(build(spark, [list("ABAB")], VOCAB, SMALL), SMALL).head()
    assert r.attention_mask == [1] * 6 + [0] * 2
    assert r.ngram_input_ids == [5, 7, 9, 0] and r.ngram_attention_mask == [1, 1, 1, 0]
    assert r.ngram_attention_match == [[0, 1, 1, 1, 1, 0, 0, 0], [0, 1, 1, 1, 0, 0, 0, 0], [0, 0, 1, 1, 0, 0, 0, 0], [0] * 8]


def test_record_variants(spark):
    cap2 = rec.Shape(8, 2, 3, 2)
    assert rec.dense(build(spark, [list("ABAB")], VOCAB, cap2), cap2).head().ngram_input_ids == [5, 7]
    r = rec.dense(build(spark, [["A"]], VOCAB, SMALL), SMALL, pad=False).head()
    assert r.ngram_input_ids == [0] and len(r.ngram_attention_match) == 1
    m = rec.model_ready(rec.dense(build(spark, [list("ABAB")], VOCAB, SMALL), SMALL), SMALL).head()
    assert m.ngram_position_matrix[1] == [1, 1, 0, 0] and m.ngram_attention_mask == [True, True, True, False]
    same = {"A B": 5, "B A": 5, "A B A": 0}
    r = rec.dense(build(spark, [list("ABAB")], same, SMALL), SMALL).head()
    assert r.ngram_input_ids[:2] == [5, 0] and r.ngram_attention_mask == [1, 0, 0, 0]


def test_against_loops(spark):
    r = random.Random(3)
    docs = [[r.choice("ABCD") for _ in range(r.randint(0, 20))] for _ in range(60)]
    vocab = {" ".join(r.choice("ABCD") for _ in range(r.randint(2, 3))): i + 1 for i in range(25)}
    shape = rec.Shape(14, 2, 3, 5)
    got = {x.doc_id: [(g.id, g.pos) for g in x.ngrams] for x in build(spark, docs, vocab, shape).collect()}
    assert got == {i: model(d, vocab, shape) for i, d in enumerate(docs)}


def test_hits_keep_order_and_bounds(spark):
    d = spark.createDataFrame([(1, list("ABAB"))], "doc_id bigint, tokens array<string>")
    v = spark.createDataFrame(list(VOCAB.items()), "ngram string, ngram_id int")
    got = sorted((x.start, x.end, x.ngram) for x in ngrams.hits(d, "tokens", v, 2, 3).collect())
    assert got == [(0, 2, "A B"), (0, 3, "A B A"), (1, 3, "B A"), (2, 4, "A B")]


def test_fold_order(spark):
    for grams, cand, gone in [
        ([[1, 2, 3], [3, 4]], [3, 4], [2]),
        ([[3, 4], [1, 2, 3]], [1, 2, 3, 4], [1, 2]),
        ([[3, 4], [1, 2, 3], [1, 8], [9, 10]], [1, 2, 3, 4, 8], [1, 2, 3]),
    ]:
        rows = [([4], [(i + 1, g) for i, g in enumerate(grams)])]
        df = spark.createDataFrame(rows, "c array<int>, g array<struct<id:int,pos:array<int>>>")
        f = df.select(masking.closure(F.col("c"), F.col("g")).alias("f")).head().f
        assert sorted(f.cand) == cand and f.removed == gone


def test_masking_invariants(spark):
    r = random.Random(5)
    docs = [[r.choice("ABCD") for _ in range(12)] for _ in range(40)]
    recs = build(spark, docs, VOCAB, rec.Shape(16, 2, 3, 4))
    kept = {x.doc_id: x for x in recs.collect()}
    out = masking.mask_record(recs, "doc_id", [2, 3, 0], 4, 20, 0.3).collect()
    again = masking.mask_record(recs.repartition(7), "doc_id", [2, 3, 0], 4, 20, 0.3).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    for x in out:
        old = kept[x.doc_id]
        for i, (a, b, y) in enumerate(zip(old.input_ids, x.input_ids, x.labels)):
            assert y == (a if i in x.candidates else -100)
            assert a == b or i in x.candidates
            assert not (i in x.candidates and a in (2, 3, 0))
        live = {g.id for g in x.ngrams} - {0}
        assert all(set(g.pos).isdisjoint(x.candidates) == (g.id in live) for g in old.ngrams)
        assert len(x.ngrams) == len(old.ngrams)
    same = masking.mask_record(recs, "doc_id", [2, 3, 0], 4, 20, 0.0).collect()
    assert all(x.input_ids == kept[x.doc_id].input_ids and set(x.labels) == {-100} for x in same)


def test_stream(spark, tmp_path):
    from loomseq.streaming import matching

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "A B A B"), (2, "x"), (3, None)], "doc_id bigint, text string").write.parquet(src)
    v = spark.createDataFrame(list(VOCAB.items()), "ngram string, ngram_id int")
    s = spark.readStream.schema("doc_id bigint, text string").parquet(src)
    matching.write_hits(matching.stream_hits(s, v, SMALL), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_rows_that_share_an_id(spark):
    """Two texts under one id give two records of full length; a repeated row gives the same one twice."""
    df = spark.createDataFrame([(1, "a b a b c"), (1, "c c d e a b"), (2, "a b"), (2, "a b"), (None, "d e")], "doc_id int, text string")
    docs = rec.tokenised(df)
    got = rec.records(docs, rec.corpus_tokens(docs), ngrams.corpus_dictionary(docs, "tokens", 2, 3, 2, 50)).collect()
    assert len(got) == 5 and all(len(r.input_ids) == len(r.attention_mask) == 512 for r in got)
    assert sorted(sum(r.attention_mask) for r in got) == [4, 4, 4, 7, 8]
    assert [r.ngrams for r in got if r.doc_id == 2][0] == [r.ngrams for r in got if r.doc_id == 2][1] != []
