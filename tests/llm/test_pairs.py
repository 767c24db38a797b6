"""SimHash, lattice hashing, components and bucket links against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomseq.llm import buckets, common, lattice, simhash


def brute_components(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    r = random.Random(4)
    n = 300
    links = [(r.randrange(n), r.randrange(n)) for _ in range(180)] + [(k, k + 1) for k in range(200, 240)] + [(0, 0), (5, 7), (5, 7)]
    want = brute_components(n, links)
    got = {x.id: x.root for x in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got.get(k, k) == want[k] for k in range(n))
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_forest():
    r = np.random.default_rng(0)
    for n, m in ((1, 0), (5, 3), (200, 150), (200, 2000)):
        i, j = r.integers(0, n, m), r.integers(0, n, m)
        assert buckets.forest(n, i, j).tolist() == brute_components(n, zip(i.tolist(), j.tolist()))
    for _ in range(200):  # dense groups, whose links settle in several rounds
        v = r.integers(0, 1000, int(r.integers(2, 200)))
        i, j = np.nonzero(np.triu(np.abs(v[:, None] - v) <= 20, 1))
        assert buckets.forest(len(v), i, j).tolist() == brute_components(len(v), zip(i.tolist(), j.tolist()))
    chain = np.arange(999)
    assert (buckets.forest(1000, chain, chain + 1) == 0).all()


@pytest.mark.parametrize("block", [3, 50, 4096])
def test_links_of_hot_buckets(spark, block):
    """Blocks of a hot bucket meet in pairs; each accepted pair counts once, with its weights."""
    r = random.Random(1)
    rows = [(7 if k < 180 else k % 40, k, r.randrange(1000), 1 + k % 3) for k in range(300)]
    df = spark.createDataFrame(rows, "key bigint, id bigint, value bigint, weight bigint").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")

    def load(b):
        return np.asarray(b.column("value"))

    def verify(v, ids, keys, i, j):
        return np.abs(v[i] - v[j]) <= 20

    got = buckets.linked(df, load, verify, block=block).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = [(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and abs(a[2] - b[2]) <= 20]
    weight, want = {x[1]: x[3] for x in rows}, {}
    for a, b in pairs:
        want[a] = want.get(a, 0) + weight[b]
        want[b] = want.get(b, 0) + weight[a]
    links = {}
    for x in got:
        links[x.id] = links.get(x.id, 0) + x.links
    assert links == want
    assert brute_components(300, [(x.id, x.root) for x in got]) == brute_components(300, pairs)


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [words] if len(words) < 4 else [words[k : k + 4] for k in range(len(words) - 3)]
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", " \n\t ", "a", "A b", "a B c d", "a b c d e", "É é X y z q", "x" * 5000, "w " * 3000, "Ä\x0bB\x0cc\rd e f"]


def test_fingerprint_of_edge_texts():
    for t in TEXTS:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


def near_documents(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        if k and r.random() < 0.5:
            words = out[r.randrange(len(out))].split()
            if words and r.random() < 0.8:
                words[r.randrange(len(words))] = f"n{k}"
            out.append(" ".join(words))
        else:
            out.append(" ".join(f"w{r.randrange(500)}" for _ in range(r.choice([0, 2, 30, 200, 400]))))
    return out


def brute_classes(texts, ids):
    fp = np.array([plain_fingerprint(t or "") for t in texts], dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), int)
    rank[order] = np.arange(len(ids))
    roots = brute_components(len(ids), [(rank[a], rank[b]) for a, b in near])
    return [ids[order[roots[rank[k]]]] for k in range(len(ids))]


def test_simhash_classes(spark):
    texts = near_documents(250, 2) + TEXTS + [None, None]
    ids = random.Random(3).sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id bigint, text string, fp string")
    got = {x.doc_id: x.component_id for x in simhash.classes(df).collect()}
    assert got == dict(zip(ids, brute_classes(texts, ids)))
    kept = simhash.dedup(df)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(got.values())) and kept.columns == df.columns


def test_simhash_links_by_distance(spark):
    """Fingerprints 0 to 6 bits apart, at random places: those up to 4 link, others don't."""
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(60)]
    pairs = []
    for k, b in enumerate(base):
        flips = sum(1 << x for x in r.sample(range(64), k % 7))
        pairs.append((b, b ^ flips, k % 7))
    rows = [(2 * k + s, int(np.uint64(p[s]).view(np.int64))) for k, p in enumerate(pairs) for s in (0, 1) if p[2] or not s]
    found = buckets.linked(simhash.bucket_rows(spark.createDataFrame(rows, "id bigint, fp bigint")), simhash._load, simhash._verify)
    linked = {x.id for x in found.collect()}
    assert linked == {2 * k + s for k, p in enumerate(pairs) for s in (0, 1) if 1 <= p[2] <= 4}


def test_simhash_empty_and_repeated_rows(spark):
    schema = "doc_id bigint, text string, n int"
    assert simhash.classes(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(5, "a b c d e", 1), (5, "a b c d e", 2), (3, "a b c d e", 3)], schema)
    assert [x.component_id for x in simhash.classes(df).collect()] == [3, 3, 3]
    assert [x.doc_id for x in simhash.dedup(df).collect()] == [3]


def test_lattice_points():
    v = lattice.NEIGHBOURS
    assert len(v) == 240 and np.allclose((v * v).sum(1), 2)
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8)) * 2
    p = lattice.nearest(x)
    twice = np.rint(2 * p).astype(int)
    assert np.allclose(2 * p, twice)
    assert all(len({t % 2 for t in row}) == 1 and sum(row) % 4 == 0 for row in twice.tolist())
    here = ((x - p) ** 2).sum(1)
    for n in v:  # no neighbour is nearer
        assert (((x - p - n) ** 2).sum(1) >= here - 1e-9).all()


def clusters(r, groups, dim=64):
    rows = []
    for size, spread in groups:
        c = r.normal(size=dim)
        c /= np.linalg.norm(c)
        z = r.normal(size=(size, dim))
        z -= (z @ c)[:, None] * c
        z /= np.linalg.norm(z, axis=1)[:, None]
        rows.append(c + spread * z * r.uniform(0, 1, (size, 1)))
    return np.concatenate(rows)


def brute_links(x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    return near


def test_lattice_classes(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([clusters(r, [(80, 0.1), (40, 0.25), (25, 0.4)] + [(2, 0.2)] * 20), r.normal(size=(200, 64))]).astype(np.float32)
    x[7] = x[3]
    x[90] = x[3]
    near = brute_links(x.astype(np.float64))
    ids = r.permutation(len(x) * 3)[: len(x)].tolist()
    bad = [(90_001, None), (90_002, [0.0] * 64), (90_003, [float("nan")] * 64), (90_004, [1.0] * 63 + [float("inf")]), (90_005, [1.0] * 63 + [None]), (90_006, [])]
    rows = [(i, v.tolist(), "x") for i, v in zip(ids, x)] + [(*b, "y") for b in bad]
    got = {a.vec_id: a for a in lattice.classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, links string")).collect()}
    found = np.array([got[i].n_links for i in ids])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.97 * near.sum()
    exact = brute_components(len(x), np.argwhere(near).tolist())
    assert sum(got[i].component_id == got[ids[0]].component_id for i, e in zip(ids, exact) if e == exact[0]) == exact.count(exact[0])
    assert got[ids[3]].n_links == got[ids[7]].n_links == got[ids[90]].n_links
    for i, _ in bad:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(a.kept == (a.vec_id == a.component_id) for a in got.values())
    assert lattice.classes(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_lattice_recall_at_threshold(spark):
    """Pairs of cosine 0.9 to 0.92 alone: the hash finds nine tenths of them."""
    r = np.random.default_rng(6)
    a = r.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z = r.normal(size=a.shape)
    z -= (z * a).sum(1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = r.uniform(0.9, 0.92, (400, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * z])
    near = brute_links(x)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = np.array([q.n_links for q in lattice.classes(df).orderBy("vec_id").collect()])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()


def test_lattice_of_mixed_lengths(spark):
    """Each length links as it does alone, though one batch holds all."""
    r = np.random.default_rng(11)
    parts = {dim: np.concatenate([clusters(r, [(20, 0.1)] + [(2, 0.1)] * 10, dim), r.normal(size=(20, dim))]) for dim in (24, 64)}
    schema, rows = "vec_id bigint, embedding array<double>", []
    for base, x in zip((0, 1000), parts.values()):
        rows.append([(base + k, v.tolist()) for k, v in enumerate(x)])
    alone = sorted(tuple(x) for part in rows for x in lattice.classes(spark.createDataFrame(part, schema)).collect())
    long = (5000, r.normal(size=300).tolist())
    mixed = spark.createDataFrame(rows[0] + [long] + rows[1], schema).coalesce(1)
    assert sorted(tuple(x) for x in lattice.classes(mixed).collect()) == [*alone, (5000, 0, 5000, True)]
    assert sum(x[1] for x in alone) > 2 * 20 * 19


@pytest.mark.parametrize("dim", [16, 64, 384, 768])
def test_lattice_meets_in_any_dimension(dim):
    """At the threshold nine tenths meet and pass the sketch; of unrelated pairs fewer than one in a hundred meet."""
    r, t = np.random.default_rng(12), lattice.tables_of(dim)
    a, z = r.normal(size=(2, 600, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z -= (z * a).sum(1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * z

    def met(x, y):
        return ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)

    x, y = t.cells(a), t.cells(b)
    assert met(x, y).mean() >= 0.9
    assert (np.bitwise_count((t.sketch(a) ^ t.sketch(b)).view(np.uint64)).sum(1) <= lattice.DIFFER).all()
    assert np.mean([met(x, np.roll(x, k, axis=0)).mean() for k in range(1, 40)]) < 0.01


def test_lattice_of_repeated_and_missing_ids(spark):
    """Different vectors under one id, equal vectors, and rows without an id are searched like others."""
    r = np.random.default_rng(13)
    c = r.normal(size=(3, 32))
    near = lambda k: (c[k] + 0.02 * r.normal(size=32)).tolist()
    rows = [(4, near(0)), (4, near(1)), (9, near(0)), (7, near(1)), (None, near(0)), (None, near(2)), (None, near(2)), (1, None), (None, None)]
    rows.append((9, rows[2][1]))
    got = lattice.classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    count = lambda *x: sum(tuple(g) == x for g in got)
    assert len(got) == len(rows)
    assert count(4, 3, 4, True) == 1 and count(9, 3, 4, False) == 2 and count(None, 3, 4, False) == 1
    assert count(4, 1, 4, True) == 1 and count(7, 1, 4, False) == 1 and count(None, 1, None, False) == 2
    assert count(1, 0, 1, True) == 1 and count(None, 0, None, False) == 1


def test_held_out(spark):
    import zlib

    df = spark.createDataFrame([(k,) for k in range(200)] + [(None,)], "d bigint").select("d", common.held_out(F.col("d"), 5, 0).alias("h"))
    assert all(x.h == (x.d is not None and zlib.crc32(str(x.d).encode()) % 5 == 0) for x in df.collect())
