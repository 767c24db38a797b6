"""The pipeline's near-copy stage against brute-force Jaccard."""

import random

import numpy as np

import corpus_pipeline
from loomseq.llm import nearcopies
from test_pairs import brute_components

SCHEMA = "doc_id bigint, text string, source string"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or (bool(a | b) and 5 * len(a & b) >= 4 * len(a | b))


def texts_of(r, n):
    """Documents, and copies with some words changed or cut off, many of them near 0.8."""
    out = []
    for k in range(n):
        if k > 20 and r.random() < 0.7:
            words = out[r.randrange(len(out))].split()
            for _ in range(r.randrange(1 + len(words) // 40)):
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
            out.append(" ".join(words[: len(words) - r.randrange(1 + len(words) // 8)]))
        else:
            out.append(" ".join(f"w{r.randrange(400)}" for _ in range(r.choice([3, 40, 120, 300]))))
    return out + ["", None, " \n", "A b c", "a B c"]


def test_stage_keeps_one_of_each_component(spark):
    texts = texts_of(random.Random(4), 300)
    sets = [grams(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])]
    assert sum(similar(sets[a], sets[b]) and sets[a] != sets[b] for a, b in links) > 100
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], SCHEMA).repartition(5)
    kept = corpus_pipeline.drop_near_copies(spark, df, None)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect()} == set(brute_components(len(texts), links))


def test_hot_group(spark, monkeypatch):
    """A group of near copies over several blocks, none a link of all others."""
    monkeypatch.setattr(nearcopies, "BLOCK", 16)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :]), "s") for k in range(150)] + [(999, "some other text of six words", "s")]
    assert {x.doc_id for x in nearcopies.dedup(spark.createDataFrame(rows, SCHEMA)).collect()} == {0, 999}


def test_null_and_repeated_ids_keep_distinct_texts(spark):
    a, b, c = ("one two three four five six seven", "a b c d e f g h", "eight nine ten eleven twelve")
    rows = [(None, a, "s"), (None, b, "s"), (5, c, "s"), (5, a, "t"), (5, a, "t"), (None, c, None)]
    got = nearcopies.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, a, "t"), (5, c, "s"), (None, b, "s")]))
    assert nearcopies.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands():
    r = np.random.default_rng(3)
    s = np.unique(r.integers(0, 1 << 64, 5000, dtype=np.uint64))
    assert nearcopies.bands(s) == nearcopies.bands(s.copy()) and len(set(nearcopies.bands(s))) == nearcopies.BANDS
    assert nearcopies.bands(s[:0]) == []


def test_stage_links_by_fingerprints_and_by_sets(spark):
    """The pipeline's stage is SimHash, which weighs repeats as sets don't; near copies beyond its budget go as well, and rows
    without an id or with a shared one are kept like others."""
    import corpus_pipeline

    tail = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    base = [f"b{i}" for i in range(120)]
    near = " ".join(base[:115] + ["other"] + base[116:])
    rows = [(1, "p " * 80 + tail(1)), (2, "p " * 80 + tail(2)), (3, " ".join(base)), (4, near), (None, tail(5)), (6, tail(6)), (6, tail(7))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "6", "6", "None"]
