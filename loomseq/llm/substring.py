"""Substring deduplication by content-defined chunking.

A gear rolling hash runs over the text (ASCII lower-cased, white space as blanks); after a blank, a
chunk ends where the hash's bits 8-15 are below CUT, with chance 1/5, so a chunk has five words on
average. Those bits depend on the last 16 bytes alone: cuts inside a passage are the same in every
document, and an insertion moves only the chunks that it touches. There is no forced cut. Where LONG
bytes or more stand without a blank, as in scripts that have none, a chunk may also end between two
characters, by INNER; such a run counts as a word for every UNIT bytes.

A window is the shortest sequence of neighbouring chunks from one on, or up to one, that has MIN_WORDS
words. Windows with the same words in different documents are copies; a copied window goes, except from
the first document: that of the smallest doc_id, null last, then of the smallest hash of its row. So
every chunk that goes lies in MIN_WORDS or more consecutive words that stand in one place of an earlier
document; chunks that only occur here and there stay, and so does what a document repeats in itself.
Windows of both kinds cover all chunks inside a passage: it keeps up to a chunk at either end, and one
of 50 words is found in 99 of 100 cases. A text of fewer than MIN_WORDS words never loses any.

A document is a row by doc_id and text: rows that agree in both are one document, which loses nothing to
itself; rows that share an id, or have none, but differ in text are documents of their own. Marks are
kept by digest, so that a row can only lose windows that it holds. Digests have 64 bits; a clash touches
one window. Null and empty texts stay as they are, an empty table gives an empty one, and a text is read
whole whatever its length. dedup() passes all columns; in report() a column of a name that report()
gives itself makes room.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm.common import map_batches, materialise, texts_of, unused

CUT, MIN_WORDS, SEED = 51, 15, 7
LONG, INNER, UNIT = 32, 16, 12
_FOLD = bytes(32 if chr(c).isspace() and c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_GEAR = np.random.default_rng(SEED).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] modulo 2**16 at every place, by doubling the window."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h = more
    return h


def folded(text: bytes) -> bytes:
    return text.translate(_FOLD)


def bounds(flat: bytes) -> list[int]:
    """Chunk borders of a folded text, 0 and its length included."""
    data = np.frombuffer(flat, dtype=np.uint8)
    n = len(data)
    if not n:
        return [0]
    bits, blanks = gear(data) >> np.uint16(8), np.nonzero(data == 32)[0]
    at = blanks[bits[blanks] < CUT] + 1
    before = np.concatenate([[-1], blanks])
    far = np.nonzero(np.diff(np.append(before, n)) > LONG)[0]
    if len(far):  # borders inside long runs without a blank, before the first byte of a character
        inner = [np.arange(before[k] + LONG, (before[k + 1] if k + 1 < len(before) else n) - 1) for k in far.tolist()]
        place = np.concatenate(inner)
        at = np.union1d(at, place[(bits[place] < INNER) & (data[place + 1] & 0xC0 != 0x80)] + 1)
    return [0, *at.tolist()] + ([n] if not len(at) or at[-1] != n else [])


def units(words: list[bytes]) -> int:
    """Words, where long ones count by their bytes."""
    return len(words) + sum(len(w) // UNIT - 1 for w in words if len(w) > LONG)


def split(text: bytes) -> tuple[list[int], list[bytes], list[int]]:
    """Borders, words as a line, and word counts of the chunks."""
    flat = folded(text)
    b = bounds(flat)
    words = [flat[s:e].split() for s, e in zip(b, b[1:])]
    return b, [b" ".join(w) for w in words], [units(w) for w in words]


def chunks(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """Borders, digests and word counts. A chunk's digest is that of its words, blanks aside; a
    chunk without words has digest 0 and counts as a copy only inside a run."""
    b, lines, n = split(text)
    digest = xxhash.xxh3_64_intdigest
    return b, [digest(x) - (1 << 63) if x else 0 for x in lines], n


def windows(words: list[int], least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Sorted windows [s, e) of chunks by their word counts: the shortest with enough words from each
    chunk on, and up to each chunk. They start and end with chunks that have words."""
    n = np.array(words, dtype=np.int64)
    at = np.nonzero(n)[0]
    ends = np.cumsum(n[at])
    starts = ends - n[at]
    last = np.searchsorted(ends, starts + least)
    on = np.nonzero(last < len(at))[0]
    first = np.searchsorted(starts, ends - least, side="right") - 1
    to = np.nonzero(first >= 0)[0]
    s, e = np.concatenate([at[on], at[first[to]]]), np.concatenate([at[last[on]], at[to]]) + 1
    return sorted(set(zip(s.tolist(), e.tolist())))


def window_digests(text: bytes) -> tuple[list[int], list[int], list[tuple[int, int]], list[int]]:
    """Borders and word counts of the chunks; the windows and the digests of their words."""
    b, lines, n = split(text)
    over = windows(n)
    digest = xxhash.xxh3_64_intdigest
    return b, n, over, [digest(b" ".join([x for x in lines[s:e] if x])) - (1 << 63) for s, e in over]


def window_rows(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, row) for each window of the rows (doc_id, text, row)."""

    def run(b: pa.RecordBatch):
        d, i, r = [], [], []
        for doc, row, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), texts_of(b)):
            digests = window_digests(text)[3]
            d += digests
            i += [doc] * len(digests)
            r += [row] * len(digests)
            if len(d) > 200_000:
                yield {"digest": d, "doc_id": i, "row": r}
                d, i, r = [], [], []
        yield {"digest": d, "doc_id": i, "row": r}

    return map_batches(docs.select("doc_id", "text", "row"), run, "digest bigint, doc_id bigint, row bigint")


def runs(copied: list[bool], words: list[int], least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Maximal runs [s, e) of copied chunks with enough words. Wordless chunks don't end a run."""
    out, k, n = [], 0, len(words)
    while k < n:
        if not copied[k]:
            k += 1
            continue
        s, total, e = k, 0, k
        while k < n and (copied[k] or not words[k]):
            if copied[k]:
                total += words[k]
                e = k + 1
            k += 1
        if total >= least:
            out.append((s, e))
    return out


def clean(text: bytes, marks: dict[int, int | None]) -> tuple[bytes, list[tuple[int, int]], int, int, set[int | None]]:
    """The text without copied windows, the byte spans that went, their words, the number of chunks,
    and the documents that hold the first copies. marks: first document by digest."""
    if not marks:
        return text, [], 0, len(bounds(folded(text))) - 1, set()
    b, words, over, digests = window_digests(text)
    copied, firsts = [False] * len(words), set()
    for (s, e), d in zip(over, digests):
        if d in marks:
            copied[s:e] = [True] * (e - s)
            firsts.add(marks[d])
    kept, at, spans, lost = [], 0, [], 0
    for s, e in runs(copied, words):
        kept.append(text[at : b[s]])
        at = b[e]
        spans.append((b[s], b[e]))
        lost += sum(words[s:e])
    kept.append(text[at:])
    return b"".join(kept), spans, lost, len(words), firsts


def row_key():
    """A hash of doc_id and text, which name a document."""
    return F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text")


def marked(docs: DataFrame) -> DataFrame:
    """(row, marks map<bigint, bigint>): by row_key(), digests of windows that stand in an earlier
    document too, with the doc_id of the first. The table is joined with the repeated digests only; both
    sides are dealt by digest after partial aggregation, and adaptive execution splits the digest of a very
    common line. Windows are cut once for either side: written, they would take more disk than the cuts
    take time. Where no two texts share an id, ids alone give the order, which hashes aggregate in place."""
    keyed = docs.select("doc_id", "text", row_key().alias("row"))
    both = [F.min("row").alias("low"), F.max("row").alias("high")]
    rows = window_rows(keyed)
    if keyed.groupBy("doc_id").agg(*both).where("low <> high").isEmpty():
        repeated = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), *both).where("low <> high").select("digest", "first")
        hits = rows.join(repeated, "digest").where("not doc_id <=> first")
    else:
        first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("first")
        repeated = rows.groupBy("digest").agg(first, *both).where("low <> high")
        hits = rows.join(repeated.select("digest", F.col("first.doc_id").alias("first"), F.col("first.row").alias("head")), "digest").where("row <> head")
    return hits.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("digest", "first"))).alias("marks"))


_EXTRA = {"n_chunks": "int", "removed_words": "int", "removed_spans": "array<struct<start:int,end:int>>", "first_docs": "array<bigint>"}


def _report(docs: DataFrame, extra: list[str]) -> DataFrame:
    """docs with the cleaned text and the columns of _EXTRA, under the names in extra."""
    names = docs.columns
    row, marks = unused([*names, *extra], "row", "marks")
    table = materialise(marked(docs)).select(F.col("row").alias(row), F.col("marks").alias(marks))
    both = docs.withColumn(row, row_key()).join(table, row, "left").drop(row)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` {t}" for n, t in zip(extra, _EXTRA.values())])

    def run(b: pa.RecordBatch):
        was = b.column("text").cast(pa.binary()).to_pylist()
        got = [clean(t or b"", dict(m or ())) for t, m in zip(was, b.column(marks).to_pylist())]
        out = {n: b.column(n) for n in names}
        new = pa.array([None if t is None else x[0] for t, x in zip(was, got)], type=pa.binary())
        spans = [[{"start": s, "end": e} for s, e in x[1]] for x in got]
        firsts = [sorted(x[4], key=lambda d: (d is None, d)) for x in got]
        return out | {"text": new.cast(pa.string())} | dict(zip(extra, ([x[3] for x in got], [x[2] for x in got], spans, firsts)))

    return map_batches(both, run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Columns of docs with the cleaned text, and n_chunks, removed_words, removed_spans (bytes of
    the old text) and first_docs (documents that keep the removed passages)."""
    return _report(docs.drop(*[c for c in docs.columns if c.lower() in _EXTRA]), list(_EXTRA))


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the repeated passages; documents of which nothing is left go, others stay."""
    extra = unused(docs.columns, *_EXTRA)
    return _report(docs, extra).where(F.col(extra[1]).eqNullSafe(0) | (F.trim("text") != "")).select(*[F.col(f"`{c}`") for c in docs.columns])
