"""N-grams that occur twice, against plain loops."""

import random
from collections import Counter

import pytest

from loomseq.operators import repeats


def expected(rows, low, high, most):
    lists = [(k, (t or "").split()) for k, t in rows]
    seen = Counter(" ".join(d[s : s + n]) for _, d in lists for n in range(low, high + 1) for s in range(len(d) - n + 1))
    out = []
    for k, d in lists:
        cut = d[:most]
        grams = [(" ".join(cut[s : s + n]), s, s + n) for n in range(low, high + 1) for s in range(len(cut) - n + 1)]
        out += [(k, g, s, e) for g, s, e in grams if seen[g] > 1]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.ngram, r.start, r.end) for r in df.collect()), key=str)


def some(seed, n=80):
    r = random.Random(seed)
    texts = [" ".join(r.choices("abcdefghijklmnop", k=r.randrange(40))) for _ in range(n)]
    # Ids that repeat or are missing, texts that are missing, empty or alone, and copies.
    rows = [(k // 2, t) for k, t in enumerate(texts)] + [(None, texts[3]), (901, None), (902, ""), (903, "  "), (904, "one"), (905, "q r\tq r")]
    return rows + [(910 + k, "x y z " * 9) for k in range(5)]


@pytest.mark.parametrize("shape", [(2, 5, 20), (1, 3, 9), (3, 3, 50), (2, 6, 1)])
@pytest.mark.parametrize("block", [1 << 20, 60])
def test_repeats_against_loops(spark, monkeypatch, shape, block):
    """Also where texts make many blocks, of one row each at last."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr("loomseq.operators.ngrams.ROWS", 3)
    rows = some(sum(shape))
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens string").repartition(3)
    assert got(repeats.hits(docs, "tokens", *shape)) == expected(rows, *shape)


def test_repeats_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, "a b c d e f")]):
        docs = spark.createDataFrame(rows, "doc_id bigint, tokens string")
        assert got(repeats.hits(docs, "tokens", 2, 5, 510)) == []


def test_keys_of_any_type(spark):
    docs = spark.createDataFrame([("p", "a b c"), ("q", "b c")], "doc_id string, tokens string")
    assert got(repeats.hits(docs, "tokens", 2, 5, 510)) == [("p", "b c", 1, 3), ("q", "b c", 0, 2)]


def test_hashes_that_agree_in_64_bits_stay_apart():
    import numpy as np

    order, new = repeats._grouped(np.array([5, 5, 5, 2], np.uint64), np.array([1, 9, 1, 1], np.uint64))
    assert order.tolist() in ([3, 0, 2, 1], [3, 2, 0, 1]) and new.tolist() == [True, True, False, True]


def test_large_hits_shuffle_less_than_their_texts(spark, tmp_path):
    """Neither windows nor matches are shuffled as rows: before, each window went as a string."""
    from loomseq import queries

    r = random.Random(1)
    rows = [(k, " ".join(f"word{r.randrange(300)}" for _ in range(60))) for k in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.ngram_hits_large(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ngram" in plan and "Generate" not in plan and "array_join" not in plan
    assert sorted((x.doc_id, x.ngram, x.start_pos, x.end_pos) for x in df.collect()) == expected_by_id(rows)


def expected_by_id(rows):
    return sorted(expected(rows, 2, 5, 510))
