"""TIFF, tokens, packing, mixing, the pipeline and the registry."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq.llm import mixing, packing, tiff, wordpiece


# --- tiff ------------------------------------------------------------------------------------

CODECS = [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]


def samples(r):
    yield b""
    yield b"a"
    yield b"aaaa" * 500
    yield bytes(r.randrange(256) for _ in range(20_000))
    yield bytes(r.choice(b"ab") for _ in range(30_000))
    yield ("the cat and the dog, " * 2000).encode()


@pytest.mark.parametrize("how", CODECS)
def test_codecs(how):
    for data in samples(random.Random(1)):
        assert tiff.decompress(tiff.compress(data, how), how, len(data)) == data


def test_known_streams():
    packed = bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa")
    assert tiff.unpack_bits(packed, 24) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)
    # The worked example of the TIFF 6.0 specification: 7 7 7 8 8 7 7 6 6 with codes of nine bits.
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], 0
    for c in codes:
        bits = bits << 9 | c
    raw = (bits << 7).to_bytes(11, "big")
    assert tiff.unpack_lzw(raw, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.pack_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


@pytest.mark.parametrize("how", CODECS)
@pytest.mark.parametrize("layout", [{}, {"rows": 7}, {"tile": (16, 16)}, {"predictor": 2, "rows": 5}, {"predictor": 2, "tile": (32, 16)}])
def test_round_trip(how, layout):
    r = np.random.default_rng(2)
    images = [r.integers(0, 9, s, dtype=k) for s, k in (((33, 21, 1), np.uint8), ((16, 40, 3), np.uint8), ((9, 17, 1), np.uint16))]
    back = tiff.decode(tiff.write(images, [layout | {"compression": how}] * 3))
    assert len(back) == 3 and all((a == b).all() and a.dtype == b.dtype for a, b in zip(images, back))


def test_big_endian_planar():
    """A hand-made MM file with two planes and sixteen-bit samples."""
    planes = [(np.arange(6) * 300).astype(">u2"), (np.arange(6) + 7).astype(">u2")]
    body = b"".join(p.tobytes() for p in planes)
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 2, (16, 16)), (259, 3, 1, 1), (273, 3, 2, (8, 20)), (277, 3, 1, 2), (278, 3, 1, 2), (279, 3, 2, (12, 12)), (284, 3, 1, 2)]
    out = struct.pack(">2sHI", b"MM", 42, 8 + len(body)) + body + struct.pack(">H", len(tags))
    for t, k, n, v in tags:
        out += struct.pack(">HHI", t, k, n) + struct.pack(">HH", *(v if n == 2 else (v, 0)))
    (p,) = tiff.decode(out + struct.pack(">I", 0))
    assert (p[..., 0].ravel() == planes[0]).all() and (p[..., 1].ravel() == planes[1]).all()


def test_pages_of_broken_files(spark):
    good = tiff.write([np.zeros((4, 4, 1), np.uint8)] * 2, [{"compression": tiff.DEFLATE}] * 2)
    loop = bytearray(good)
    at = struct.unpack_from("<I", good, 4)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * struct.unpack_from("<H", good, at)[0], at)
    rows = [(1, good), (2, good[: len(good) // 2]), (3, b"no"), (4, None), (5, bytes(loop)), (6, b"")]
    got = tiff.pages(spark.createDataFrame(rows, "k int, media binary"), "k", "media").collect()
    assert sorted((x.k, x.page) for x in got) == [(1, 0), (1, 1), (2, -1), (3, -1), (5, -1), (6, -1)]
    assert all((x.error is None) == (x.k == 1) for x in got)


def altered(good, tag, value):
    """The file with another value in the first directory's entry of a tag."""
    out, at = bytearray(good), struct.unpack_from("<I", good, 4)[0]
    for k in range(struct.unpack_from("<H", good, at)[0]):
        place = at + 2 + 12 * k
        if struct.unpack_from("<H", good, place)[0] == tag:
            struct.pack_into("<I", out, place + 8, value)
    return bytes(out)


def test_reader_never_fails_a_job(spark):
    """Sizes of nought, absurd sizes, missing strips, bad codes, and any single byte changed."""
    img = np.arange(48 * 8, dtype=np.uint8).reshape(8, 48, 1)
    strips, tiles = (tiff.write([img], [lay]) for lay in ({"compression": tiff.LZW, "rows": 4}, {"tile": (16, 16), "compression": tiff.DEFLATE}))
    bad = [altered(strips, tiff.ROWS_PER_STRIP, 0), altered(tiles, tiff.TILE_WIDTH, 0), altered(strips, tiff.WIDTH, 0xFFFFFFFF), altered(strips, tiff.HEIGHT, 0xFFFFFFF0), altered(strips, tiff.HEIGHT, 16), altered(strips, tiff.WIDTH, 100_000)]
    lzw = bytearray(strips)
    lzw[8:10] = b"\xff\xff"
    bad.append(bytes(lzw))
    r = random.Random(6)
    flipped = []
    for good in (strips, tiles):
        for _ in range(300):
            x = bytearray(good)
            x[r.randrange(len(x))] = r.randrange(256)
            flipped.append(bytes(x))
    rows = [(k, x) for k, x in enumerate(bad + flipped)]
    got = tiff.pages(spark.createDataFrame(rows, "k int, media binary"), "k", "media").collect()
    assert {x.k for x in got} == set(range(len(rows))) - {x for x in range(len(rows)) if rows[x][1][4:8] == b"\0\0\0\0"}
    assert all(x.page == -1 and x.error for x in got if x.k < len(bad))


@pytest.mark.parametrize("how", CODECS)
def test_small_samples(how):
    """One and four bits a sample, rows padded to whole bytes."""
    r = np.random.default_rng(4)
    for bits, w in ((1, 37), (4, 13)):
        img = r.integers(0, 1 << bits, (9, w), dtype=np.uint8)
        raw = np.packbits(img, axis=1) if bits == 1 else (lambda p: p[:, ::2] << 4 | p[:, 1::2])(np.pad(img, ((0, 0), (0, w % 2))))
        data = altered(altered(tiff.write([np.ascontiguousarray(raw)[:, :, None]], [{"compression": how, "rows": 4}]), tiff.WIDTH, w), tiff.BITS, bits)
        (back,) = tiff.decode(data)
        assert (back[:, :, 0] == img).all()


def test_store_uses_every_layout(spark):
    seen = {tiff.zlib.crc32(tiff.payload_of(b"text %d" % k)) % len(tiff.LAYOUTS) for k in range(60)}
    assert seen == set(range(len(tiff.LAYOUTS))) and {x["compression"] for x in tiff.LAYOUTS} == set(CODECS)


def test_digest(spark):
    r = random.Random(3)
    texts = [None, "", "x", "é" * 288, "y" * 576, "z" * 577, "".join(chr(r.randrange(32, 500)) for _ in range(90_000)), "x"]
    df = spark.createDataFrame([(k, t, "p") for k, t in enumerate(texts)], "doc_id bigint, text string, feature string")
    got = {x.doc_id: x for x in tiff.digest(df).collect()}
    import hashlib

    for k, t in enumerate(texts):
        raw = (t or "").encode()
        size = max(576, -(-len(raw) // 576) * 576)
        payload = raw + b"\xff" * (size - len(raw))
        media = tiff.store(payload)
        x = got[k]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (x.media_bytes, x.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[2].feature == got[7].feature and got[0].media_sha256 == got[1].media_sha256
    assert len(tiff.decode(tiff.store(b"q" * 576 * 200))) == 4
    assert tiff.digest(df.limit(0)).count() == 0


# --- tokens and packing ----------------------------------------------------------------------

TEXTS = [
    None, "", " ", "Hello, World! it's I'LL 1234 don't", "a\u0085b c d　e​f", "x\x1cy\x1fz \x1c", "é ́ Å 각", "ΣΑΣ ΟΔΟΣ İı",
    "<|endoftext|> a<|startoftext|>b <|endoftext", "日本語のテキスト 😀👩‍👩‍👧", "word " * 5000, "z" * 3000, "﻿bom   line", "ß ẞ ﬁ",
]


def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_equal_the_tokenizer():
    t = reference()
    for _ in range(2):
        for text, ids in zip(TEXTS, wordpiece.encode(TEXTS)):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_cuts():
    for n in [*range(1, 9000), 50_000]:
        c = packing.cut(n)
        assert sum(c) == n and all(0 < x <= packing.CAPACITY for x in c)


def check_packing(rows, texts, capacity=4096):
    """Every id in one piece, sequences gapless and within the capacity; returns the padding."""
    t, by, seq = reference(), {}, {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
        seq.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert set(by) == set(texts)
    for k, text in texts.items():
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 2], 0
        for x in sorted(by[k], key=lambda x: x.start):
            part = np.array(ids[at : at + x.length], "<u4").tobytes()
            assert (x.start, x.ids_crc32, x.doc_tokens) == (at, zlib.crc32(part), len(ids))
            at += x.length
        assert at == len(ids)
    total = pad = 0
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
        total, pad = total + at, pad + (0 if at & (at - 1) == 0 else capacity - at)
    return total, pad, len(seq)


def test_pack(spark):
    r = random.Random(4)
    texts = dict(enumerate(TEXTS)) | {100 + k: " ".join(r.choice(["alpha", "be", "gamma3", "d,"]) for _ in range(r.choice([1, 5, 60, 700, 4000]))) for k in range(150)}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id bigint, text string, length int")
    total, pad, n = check_packing(packing.pack(df).collect(), texts)
    assert pad <= 4096 + 0.01 * total
    empty = packing.pack(df.limit(0))
    assert empty.count() == 0 and empty.columns[:3] == ["doc_id", "start", "length"]


def test_full_sequences_have_a_fixed_count(spark):
    df = spark.createDataFrame([(k, "word " * 1364) for k in range(800)], "doc_id bigint, text string")
    rows = packing.pack(df).collect()
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append(x.length)
    assert sum(v == [1365] * 3 for v in by.values()) >= 260


def test_numbers_of_sequences_are_distinct(spark, monkeypatch):
    """The parts of a number have bits of their own; small shards over several levels, no row with an id."""
    spans = (4096, 1 << packing.LEVEL_BITS, 1 << packing.SHARD_BITS, 1 << packing.BIN_BITS)
    corners = [(k, a, s, b) for k in (1, 2, spans[0]) for a in (1, spans[1] - 1) for s in (0, 1, spans[2] - 1) for b in (0, 1, spans[3] - 1)]
    numbers = {packing._number(*c) for c in corners}
    assert len(numbers) == len(corners) and 0 <= min(numbers) and max(numbers) < 1 << 63
    monkeypatch.setattr(packing, "SHARD_ROWS", 4)
    monkeypatch.setattr(packing, "SHARD_BINS", 2)
    r = random.Random(5)
    df = spark.createDataFrame([(None if k % 3 else 5, "word " * r.choice([1, 300, 1364, 2047])) for k in range(900)], "doc_id bigint, text string")
    rows = packing.pack(df).collect()
    assert sum(x.length for x in rows) == sum(x.doc_tokens for x in rows if x.start == 0)
    seq = {}
    for x in rows:
        seq.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    full = sum(sum(n for _, n in p) > 4000 for p in seq.values())
    assert full >= 0.9 * len(seq)


# --- mixing ----------------------------------------------------------------------------------

def test_targets():
    t = mixing.targets([("b", 100), ("a", 100), (None, 100)])
    assert t == pytest.approx({"a": 200.0, "b": 250 / 3, None: 500 / 3})
    assert sum(t.values()) == pytest.approx(450)
    small = mixing.targets([("a", 1), ("b", 1000)])
    assert small == pytest.approx({"a": 2.0, "b": 1499.5})
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_flight_keeps_both_totals():
    r = random.Random(5)
    size = [r.randrange(0, 5000) for _ in range(700)]
    p = [r.choice([0.25, 0.6]) for _ in size]
    tokens, docs = sum(a * b for a, b in zip(size, p)), sum(p)
    q = list(p)
    mixing.fly(size, q, random.Random(1), 2)
    assert sum(0 < x < 1 for x in q) <= 2 and all(0 <= x <= 1 for x in q)
    assert sum(a * b for a, b in zip(size, q)) == pytest.approx(tokens, rel=1e-6) and sum(q) == pytest.approx(docs, rel=1e-6)
    same = [0.5] * 9
    mixing.fly([7] * 9, same, random.Random(1), 2)
    assert sum(0 < x < 1 for x in same) <= 2


def test_inclusion_probabilities_hold():
    size, hits = [random.Random(6).randrange(1, 50) for _ in range(30)], np.zeros(30)
    for k in range(2000):
        p = [0.3] * 30
        mixing.fly(size, p, random.Random(k), 2)
        hits += p
    assert np.abs(hits / 2000 - 0.3).max() < 0.05


def corpus(n=6000):
    r = random.Random(7)
    pick = lambda: "big" if r.random() < 0.6 else r.choice(["a", "é", None, "zz"])
    return [(k, None if k == 9 else "w " * r.choice([0, 1, 30, 200, 900]), pick(), 1) for k in range(n)]


def test_plan(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = mixing.plan(df).collect()
    assert sorted(x.doc_id for x in got) == list(range(len(rows)))
    totals = {}
    for k, t, s, _ in rows:
        totals[s] = totals.get(s, 0) + len((t or "").split())
    want = mixing.targets(list(totals.items()))
    taken = dict.fromkeys(totals, 0)
    for x in got:
        assert x["size"] == len((rows[x.doc_id][1] or "").split()) and 0 <= x.taken <= 2 * x["size"] and x.taken == x.times * x["size"]
        assert x.source_size == totals[x.source] and x.target == pytest.approx(want[x.source])
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 1 + 0.001 * want[s] for s in totals)
    assert sorted(map(tuple, mixing.plan(df.repartition(5)).drop("source").collect())) == sorted(map(tuple, mixing.plan(df).drop("source").collect()))
    mixed = mixing.mix(df)
    times = {x.doc_id: x.times for x in got}
    seen = {}
    for x in mixed.collect():
        seen[x.doc_id] = seen.get(x.doc_id, 0) + 1
    assert seen == {k: n for k, n in times.items() if n} and mixed.columns == df.columns


@pytest.mark.parametrize("n", [1, 2, 5, 400])
def test_source_targets_as_the_plain_rule(spark, n):
    """The distributed rounds of resharing give what the list's rule gives, null, empty and equal sources included."""
    r = random.Random(n)
    names = [None, "é", "z", "\U0001f600", "\uffee"] + [f"s{k}" for k in range(n)]
    totals = [(s, int(r.paretovariate(0.4)) if r.random() < 0.9 else 0) for s in names[-n:] + names[: min(n, 5)]]
    totals = list(dict(totals).items())
    got = mixing.source_targets(spark.createDataFrame(totals, "src string, source_size bigint")).collect()
    assert {x.src: x.target for x in got} == mixing.targets(totals) and len(got) == len(totals)


def test_plan_with_more_sources_than_are_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(corpus(1500), "doc_id bigint, text string, source string, size int")
    want = sorted(map(str, mixing.plan(df).collect()))
    monkeypatch.setattr(mixing, "NEAR", 1)
    assert sorted(map(str, mixing.plan(df).collect())) == want


@pytest.mark.parametrize("counts", [{"a": 4000, "b": 900, "c": 900}, {"large": 3000, "two": 1100} | {f"s{k}": 300 for k in range(6)}])
def test_small_sources_beside_a_large_one(spark, counts):
    """A source of one block (b) lands with LANDING documents, however many blocks another has; one of
    two blocks does so a level later."""
    r = random.Random(12)
    rows = [(s, "w " * int(r.paretovariate(1.1) * 40 % 4000)) for s, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame([(k, t, s) for k, (s, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    error = {x.source: abs(x.taken - x.target) for x in mixing.plan(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert set(error) == set(counts) and max(error.values()) <= 3, error


def test_mix_by_row(spark, monkeypatch):
    """Rows without an id, many that are alike, and columns named like the helpers: each row is taken as
    the plan says, at most twice, and sources come near their targets."""
    monkeypatch.setattr(mixing, "BLOCK", 256)
    r = random.Random(15)
    rows = [(None, "w " * 40, "s", k, "a") for k in range(700)]
    rows += [(None if k % 2 else 3, " ".join(["v"] * r.randrange(1, 90)), r.choice(["s", "t", None]), 1000 + k, "b") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int, row string").withColumns({c: F.lit(1) for c in ("k", "key", "_length", "_times", "_id", "deal", "p", "times", "often")})
    got = mixing.mix(df)
    assert got.columns == df.columns
    times, words = {}, {}
    for x in got.collect():
        times[x.n] = times.get(x.n, 0) + 1
        assert x.text == rows[x.n if x.n < 1000 else x.n - 300][1] and x.k == x.p == 1
        words[x.source] = words.get(x.source, 0) + len(x.text.split())
    assert max(times.values()) <= 2
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = mixing.targets(list(sizes.items()))
    assert all(abs(words[s] - want[s]) <= 0.002 * want[s] + 2 for s in want)


def test_plan_small_and_empty(spark):
    schema = "doc_id bigint, text string, source string"
    assert mixing.plan(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, "", None)], schema)
    assert sum(x.taken for x in mixing.plan(one).collect()) in (9, 12)
    assert mixing.mix(one).where("doc_id = 1").count() in (3, 4)


# --- pipeline and registry -------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    """Each stage against what its own definition says of its input."""
    import corpus_pipeline
    from loomseq.llm import toxicity
    from loomseq.llm.common import materialise

    r = random.Random(8)
    base = [" ".join(f"t{r.randrange(3000)}" for _ in range(r.choice([40, 150]))) for _ in range(120)]
    texts = [b + (" nasty slur" if k % 6 == 0 else "") for k, b in enumerate(base)] + base[1:4]
    docs = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k % 6 == 0)) for k in range(len(base))]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring", "mixing", "packing"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = now.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = materialise(stage(spark, now, folder))
        if k < 4:
            assert now.columns == columns
        kept.append({x.doc_id for x in now.select("doc_id").collect()})
    assert kept[0] == {d[0] for d in docs if not (d[1] or "").endswith("slur")}
    assert not kept[1] & {len(base), len(base) + 1, len(base) + 2} and {1, 2, 3} <= kept[1]
    assert kept[1] - kept[2] <= {500, 501} and kept[4] == kept[3]
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, now.collect()))
    assert toxicity.MODULUS == 5


def test_registry():
    import __spark_entry__
    from loomseq.llm import registry

    names = list(registry.queries())
    assert sorted(n for n in names if n.startswith("op")) == sorted(n for n in __spark_entry__.queries() if n.startswith("op")) and len(names) == 14  # thirteen operators and the pipeline
    assert "pipeline" in __spark_entry__.queries()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op1_toxicity", "op3_quality", "op5_tiff", "op6_langid", "op7_mixing", "op9_html", "op10_substring"])
def test_queries_cover_the_table(spark, name):
    from loomseq.llm import registry

    table = "pages" if name == "op9_html" else "documents"
    assert registry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
