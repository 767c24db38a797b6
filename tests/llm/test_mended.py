"""Repeated and missing ids in SimHash classes, hot ids in the quality fit, pages in wrappers, vectors in
Arrow columns, toxicity bars."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomseq.llm import html, lattice, quality, simhash, toxicity


def slow_classes(rows):
    """Components over rows, linked by at most four bits; the least id that isn't null."""
    prints = [int(simhash.fingerprint((t or "").encode())) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if d is not None and find(j) == find(i)]
        out.append((doc, prints[i] - (prints[i] >> 63 << 64), min(ids, default=None)))
    return sorted(out, key=str)


def near(rng, words):
    """A long text that differs from words in its last one: a bit or a few of the fingerprint."""
    return " ".join([*words[:-1], rng.choice("xyz") * 3])


def test_simhash_of_repeated_and_missing_ids(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    a, b, c = ([word() for _ in range(400)] for _ in range(3))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, near(rng, a)), (9, " ".join(b)), (None, " ".join(c)), (None, near(rng, c)), (7, None), (None, ""), (2, "one"), (2, "one")]
    assert (int(simhash.fingerprint(rows[0][1].encode())) ^ int(simhash.fingerprint(rows[2][1].encode()))).bit_count() <= 4
    got = simhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("least", F.lit("x")))
    assert sorted(map(tuple, got.collect()), key=str) == slow_classes(rows)
    assert {r.component_id for r in got.collect() if r.doc_id in (5, 9)} == {3, 5}


def test_bridges_without_an_id(spark, monkeypatch):
    """Fingerprints 0, 15 and 255 are a chain, of which the middle one has no id."""
    far = (1 << 40) - (1 << 20)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: spark.createDataFrame([(1, 0), (None, 15), (0, 255), (4, far)], "doc_id bigint, fp bigint"))
    got = simhash.classes(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    assert {r.fp: r.component_id for r in got.collect()} == {0: 0, 15: 0, 255: 0, far: 4}


def test_quality_fit_with_a_hot_id(spark):
    rng = random.Random(3)
    words = {0: ["buy", "cheap", "now", "click"], 1: ["river", "mountain", "history", "garden"]}
    rows = [(k, " ".join(rng.choice(words[k % 2]) for _ in range(20)), "en", f"s{k % 2}", 100) for k in range(300)]
    rows += [(9_999, f"buy cheap {k % 50}", "en", "s0", 100) for k in range(100_000)] + [(None, "river", "en", "s1", 100)] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 200)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.keep for r in quality.scores(docs.where("doc_id < 300"), model).collect()}
    assert sum(v == k % 2 for k, v in got.items()) > 290
    unlabelled = docs.where("doc_id is not null").select("doc_id").distinct().count() - 200
    assert unlabelled == 101  # 100 ids and the hot one, which 100,000 rows share


def prose(k, times=2):
    return f"Some ordinary prose, with commas, number {k}, which goes on and on for a while so that it counts. " * times


PAGES = {
    "wrapped sections": ("<div>" + "".join(f"<section><div><p>{prose(k)}</p><p>{prose(k + 10)}</p></div></section>" for k in range(3)) + "</div>", [0, 10, 1, 11, 2, 12]),
    "rows and columns": ("".join(f"<div class=row><div class=col><p>{prose(k)}</p><p>{prose(k + 10)}</p></div></div>" for k in range(2)), [0, 10, 1, 11]),
    "uneven sections": (f"<div><section><div><p>{prose(1, 9)}</p><p>{prose(2, 9)}</p></div></section><section><div><p>{prose(3, 1)}</p></div></section></div>", [1, 2, 3]),
    "teaser card": (f"<div class=story>{''.join(f'<p>{prose(k)}</p>' for k in range(5))}</div><article class=card><h3><a href=x>More</a></h3><p>A short teaser, no more.</p></article>", [0, 1, 2, 3, 4]),
    "prose in a share box": (f"<article><p>{prose(1)}</p><div class=share><p>{prose(2)}</p></div><div class=share><a href=x>Send</a></div><p>{prose(3)}</p></article>", [1, 2, 3]),
    "comments stay out": (f"<article><p>{prose(1)}</p><div class=comments><p>{prose(2)}</p></div></article><div class=comments><div><p>{prose(3, 9)}</p></div></div>", [1]),
    "menus stay out": (f"<div><ul>{'<li><a href=x>A link, of a menu</a></li>' * 30}</ul></div><div class=a><p>{prose(1)}</p></div><div class=footer><p>{prose(2, 9)}</p></div>", [1]),
    "two articles": (f"<div><article><p>{prose(1)}</p></article><article><p>{prose(2)}</p></article></div>", [1, 2]),
    "a larger story beside a small article": (f"<div><article><p>{prose(1, 1)}</p></article><div><p>{prose(2, 9)}</p><p>{prose(3, 9)}</p></div></div>", None),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_in_wrappers(name):
    body, want = PAGES[name]
    text = html.extract(f"<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav>{body}<footer>{prose(99)}</footer></body></html>")
    found = [int(line.split("number ")[1].split(",")[0]) for line in text.split("\n")]
    assert found == want if want else {2, 3} <= set(found)
    assert "Home" not in text and "teaser" not in text and "Send" not in text


def test_matrices_as_plain_loops():
    """Null vectors and components, zeros, NaN, several lengths, and a slice of a longer column."""
    rows = [[9.0], [3.0, 4.0], None, [], [1.0, None], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [2.0], [5e-324, 0.0], [1e300, 1e300], [0.0, -7.0]]
    for kind in (pa.float64(), pa.float32()):
        column = pa.array(rows, pa.list_(kind)).slice(1)
        kept = column.to_pylist()
        want = {}
        for k, v in enumerate(kept):
            if v and None not in v and np.isfinite(v).all() and any(v):
                x = np.array(v) / np.abs(v).max()
                want.setdefault(len(v), []).append((k, (x / np.sqrt((x * x).sum())).tolist()))
        got = {u.shape[1]: list(zip(at.tolist(), u.tolist())) for u, at in lattice._matrices(column)}
        assert got == want


def test_toxicity_bars_follow_from_the_number_of_pairs():
    """So many pairs exceed a bar by chance as it says: the tail of chi-squared with one degree of freedom."""
    pairs = toxicity.AMONG * (toxicity.AMONG - 1) / 2
    for chance, bar in zip(toxicity.CHANCE, toxicity.bars()):
        assert abs(math.erfc(math.sqrt(bar / 2)) * pairs / chance - 1) < 1e-6
    assert toxicity.BARS[-1] == float("inf") and list(toxicity.BARS) == sorted(toxicity.BARS)
