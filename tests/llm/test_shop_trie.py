"""Conversation tries, funnels and URL filters against plain loops."""

import hashlib
import os
import random
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomseq.llm import funnel, registry, trie, urlfilter
from loomseq.llm.oracle import FUNNELS, RULES

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=["true", "false"])
def shards(request, spark):
    """Scans over the shards that adaptive execution sets (one, here), and over as many as there are partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# --- funnels -------------------------------------------------------------------------------------


def slow_funnel(rows, funnels):
    own = {(c, k, t) for c, k, t in rows if None not in (c, k, t)}
    by = {}
    for c, k, t in own:
        by.setdefault(c, {}).setdefault(k, []).append(t)
    out = []
    for f in funnels:
        for c, kinds in by.items():
            times = {i: [] for i in range(1, len(f.steps) + 1)}
            for first in kinds.get(f.steps[0], []):
                times[1].append(0)
                at = first
                for i, s in enumerate(f.steps[1:], 2):
                    later = [t for t in kinds.get(s, []) if t > at]
                    if not later or min(later) - first > f.within or any(at < t <= min(later) for t in kinds.get(f.exclude, [])):
                        break
                    times[i].append(min(later) - at)
                    at = min(later)
            if times[1]:
                n = [len(times[i]) for i in times]
                q = [sorted(times[i])[-(-90 * len(times[i]) // 100) - 1] if times[i] else None for i in times if i > 1]
                out.append((f.name, c, *n, max(i for i in times if times[i]), *q))
    same = {}
    for r in out:
        same[r[0], r[6]] = same.get((r[0], r[6]), 0) + 1
    return sorted((*r, same[r[0], r[6]]) for r in out)


def clicks_of(spark, rows, kind="timestamp_ntz"):
    start = datetime(2024, 1, 1)
    at = lambda t: None if t is None else start + timedelta(microseconds=t)
    data = [(c, k, at(t), "x") for c, k, t in rows]
    return spark.createDataFrame(data, f"client_id bigint, kind string, arrived_at {kind}, n string").withColumn("mask", F.lit(None).cast("int"))


def shifted(rows):
    base = int((datetime(2024, 1, 1) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    return [(c, k, None if t is None else t + base) for c, k, t in rows]


def test_funnels_like_loops(spark, shards):
    rng = random.Random(5)
    kinds = ["view", "view", "click", "click", "purchase", "signup", "error", "other", None]
    minute = funnel.MINUTE
    rows = []
    for _ in range(1500):
        c = rng.choice([1, 1, 1, 2, 3, 4, None])
        t = rng.choice([None, rng.randrange(40) * minute, rng.randrange(6) * minute * 10, rng.randrange(400 * minute)])
        rows.append((c, rng.choice(kinds), t))
    rows += rows[:200]
    wanted = [funnel.Funnel(*f) for f in FUNNELS]
    got = funnel.counts(clicks_of(spark, rows), wanted)
    assert sorted(map(tuple, got.collect())) == slow_funnel(shifted(rows), wanted)


def test_funnel_edges(spark):
    f = [funnel.Funnel("F", ("a", "b"), "x", 10)]
    cases = {
        1: [("a", 0), ("b", 10)],  # just in time
        2: [("a", 0), ("b", 11)],  # too late
        3: [("a", 0), ("b", 0)],  # not later
        4: [("a", 0), ("x", 5), ("b", 5)],  # excluded at the next step's time
        5: [("a", 5), ("x", 5), ("b", 6)],  # excluded at the first step's time doesn't lie after it
        6: [("b", 5)],
        7: [("a", 0), ("a", 0), ("a", 3), ("b", 4)],
    }
    rows = [(c, k, t) for c, own in cases.items() for k, t in own]
    for kind in ("timestamp_ntz", "timestamp"):
        got = {r.client_id: (r.n1, r.n2, r.deepest, r.t2, r.same_depth) for r in funnel.counts(clicks_of(spark, rows, kind), f).collect()}
        assert got == {1: (1, 1, 2, 10, 3), 2: (1, 0, 1, None, 3), 3: (1, 0, 1, None, 3), 4: (1, 0, 1, None, 3), 5: (1, 1, 2, 1, 3), 7: (2, 2, 2, 4, 3)}
    assert funnel.counts(clicks_of(spark, []), f).collect() == []


def test_zones_do_not_move_times(spark):
    f = [funnel.Funnel("F", ("a", "b"), "x", 3_600_000_000 * 3)]
    hour = 60 * funnel.MINUTE
    rows = [(1, "a", 90 * 24 * hour), (1, "b", 90 * 24 * hour + 2 * hour)]  # 31 March 2024, when clocks go forward
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert [r.t2 for r in funnel.counts(clicks_of(spark, rows), f).collect()] == [2 * hour]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("percent", [1, 50, 90, 100])
def test_quantile(spark, percent):
    rng = random.Random(percent)
    values = {g: [rng.choice([rng.randrange(1000), 7]) for _ in range(n)] for g, n in ((1, 1), (2, 10), (3, 333))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g int, d bigint").groupBy("g", "d").agg(F.count(F.lit(1)).alias("n"))
    got = {r.g: r.q for r in funnel.quantile(df, ["g"], 1000, percent).collect()}
    assert got == {g: sorted(v)[-(-percent * len(v) // 100) - 1] for g, v in values.items()}


# --- URL filters ---------------------------------------------------------------------------------


def slow_judge(url, rules):
    host = path = ""
    rules = [(v, h and h.lower(), p) for v, h, p in rules]
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if None not in (h, p) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


URLS = [
    "http://www.example.com/en/1?x=/y", "http://example.com/en/", "http://example.com/en", "https://Sub.EXAMPLE.com/en/a#b", "http://a.net/es/1", "http://net/fr/",
    "http://a.net/de/", "http://notexample.com/en/1", "http://x.com", "http://x.com?a=1", "x.com/en/", None, "", "://", "http://", "http://a..com/", "http://.com/", "a://b://c.com/",
    "http://x.com/\n/é?q", "http://example.com/en/" + "a/" * 30_000, "http://" + "a." * 20_000 + "com/x", "http://ÄEXAMPLE.com/", "http://example.com//en/", "http://example.com/en/x", "http://example.com/en/x",
]


def test_rules_like_loops(spark):
    more = [*RULES, ("block", "com", ""), ("block", "x.com", "/a"), ("allow", "x.com", "/a"), ("block", "", "/"), ("allow", "EXAMPLE.com", "/en/x"), ("block", None, "/"), ("allow", "a", None), ("block", "com", "/"), *RULES[:1]]
    pages = spark.createDataFrame([(k % 20 if k % 7 else None, u, "t", "h") for k, u in enumerate(URLS)], "page_id bigint, url string, rule string, host string")
    for rules in (RULES, more, []):
        table = urlfilter.rules_of(spark, *rules) if None not in {x for r in rules for x in r} else spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string")
        for bound in (10, 0):
            got = urlfilter.judge(pages, table, broadcast_rules=bound)
            assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
            want = [(k % 20 if k % 7 else None, *slow_judge(u, rules)) for k, u in enumerate(URLS)]
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_of(spark, *RULES)).collect() == []


def test_urlfilter_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    plan = urlfilter.judge(pages, urlfilter.rules_of(spark, *RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


# --- tries ---------------------------------------------------------------------------------------


def slow_rebuild(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def slow_trie(talks):
    members = {}
    for c in sorted(talks):
        for d in range(len(talks[c]) + 1):
            members.setdefault(tuple(talks[c][:d]), []).append(c)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in own if len(talks[c]) == len(p))
        out.append((own[0], len(p), members[p[:-1]][0] if p else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks_of(rng, n):
    """Conversations over a few turns, so that prefixes are shared, repeated and nested."""
    rows = []
    for c in range(-n // 4, n):
        if rng.random() < 0.85:
            for t in range(rng.choice([1, 2, 3, 5, 9])):
                rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "b", "é", "", None, "ab"])))
    return rows + [(None, 1, "user", "x"), (2, 3, "user", "a"), (2, 3, "user", "a")]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("shards,modulus", [("true", trie.Modulus((2, 3), (1, 1))), ("false", trie.Modulus((7, 5), (3, 2)))], indirect=["shards"])
def test_trie_like_loops(spark, shards, modulus):
    rows = talks_of(random.Random(11), 40)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"c": F.lit("x"), "d": F.lit(1), "split": F.lit(2)}).repartition(3)
    got = trie.nodes(*trie.rebuilt(trie.numbered(df)), modulus)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == slow_trie(slow_rebuild(rows))


@pytest.mark.parametrize("shards", ["false"], indirect=True)
def test_one_long_conversation_and_many_copies(spark, shards):
    talk = [(0, t, "user", f"w{t % 3}") for t in range(700)] + [(c, t, "user", f"w{t}") for c in range(101, 9000, 5) for t in range(2)]
    got = trie.nodes(*trie.rebuilt(trie.numbered(spark.createDataFrame(talk, SCHEMA))))
    by = {(r.conv_id, r.depth): r for r in got.collect()}
    talks = slow_rebuild(talk)
    n = len(talks)
    assert by[0, 0].n_convs == n and by[0, 0].parent_conv_id is None and by[0, 700].n_leaves == 1
    for (c, d), r in by.items():
        own = [k for k, t in talks.items() if t[:d] == talks[c][:d]]
        assert (min(own), len(own)) == (c, r.n_convs)
        assert r.ends_sha256 == hashlib.sha256(",".join(str(k) for k in sorted(own) if len(talks[k]) == d).encode()).hexdigest()


def test_tries_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.nodes(*trie.rebuilt(trie.numbered(empty))).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None)], SCHEMA)
    assert trie.nodes(*trie.rebuilt(trie.numbered(nulls))).collect() == []
    # Conversation 1 borrows from conversation 0, which isn't there, and may lose its own first turns.
    one = spark.createDataFrame([(1, None, None, None)], SCHEMA)
    assert sorted(map(tuple, trie.nodes(*trie.rebuilt(trie.numbered(one))).collect()), key=str) == slow_trie(slow_rebuild([(1, None, None, None)]))


# --- queries -------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_like_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "clicks", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    names, cur = sorted(df.columns), con.execute(registry.oracle_sql()[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == names
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted((tuple(r[at.index(c)] for c in names) for r in cur.fetchall()), key=str)
