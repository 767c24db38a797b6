"""Hashed terms: features for the small models that are fitted on the driver.

A fit takes at most SAMPLE labelled rows, those with the lowest hash of doc_id; that bound keeps the
driver's memory fixed. Scoring covers every row."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.llm.common import map_batches, texts_of

SAMPLE, BUCKETS = 20_000, 1 << 18
WORD = re.compile(r"[^\W\d_]+")
_KEEP = 100_000


class Hasher:
    """Bucket numbers of words, remembered up to a bound."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def __call__(self, words) -> list[int]:
        known, out = self.known, []
        if len(known) > _KEEP:
            known.clear()
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % self.buckets
            out.append(k)
        return out


_hasher = Hasher()


def letters(text: bytes) -> set[str]:
    """Distinct lower-cased runs of letters."""
    return set(WORD.findall(text.decode("utf-8", "replace").lower()))


def term_set(text: bytes) -> list[int]:
    return _hasher(letters(text))


def sample_ids(rows: DataFrame, *columns: str, limit: int = SAMPLE) -> DataFrame:
    """At most `limit` rows of (doc_id, columns), the same ones in every run."""
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    return rows.select("doc_id", *columns).orderBy(order, "doc_id").limit(limit)


def labels_of(labels: DataFrame, column: str, learn: Column) -> DataFrame:
    """(doc_id, y): rows to learn from; a null label is none, and of several the largest counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & learn)
    return known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))


def features_of(docs: DataFrame, picked: DataFrame, terms, extra: list[str]) -> list[tuple]:
    """(terms, extras...) of the picked documents; picked has a bounded number of rows and is broadcast.
    terms(batch, texts) gives the buckets of each row."""
    both = docs.join(F.broadcast(picked), "doc_id")
    kinds = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in extra)

    def run(b: pa.RecordBatch):
        texts = texts_of(b)
        digests = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts]
        return {"doc_id": b.column("doc_id"), "digest": digests, "terms": terms(b, texts)} | {c: b.column(c) for c in extra}

    schema = "doc_id bigint, digest bigint, terms array<int>" + (", " + kinds if kinds else "")
    # Of rows that share an id the one with the least digest of its text stays, before any comes to the driver.
    least = F.min(F.struct("digest", "terms", *[f"`{c}`" for c in extra])).alias("least")
    one = map_batches(both, run, schema).groupBy("doc_id").agg(least)
    rows = one.select("doc_id", "least.terms", *[F.col(f"least.`{c}`") for c in extra]).toArrow()
    ids = rows.column("doc_id").to_pylist()
    at = sorted(range(len(ids)), key=ids.__getitem__)
    lists = rows.column("terms").combine_chunks()
    flat, offs = np.asarray(lists.flatten(), dtype=np.int64), np.asarray(lists.offsets)
    return [flat[offs[k] : offs[k + 1]] for k in at], [[rows.column(c)[k].as_py() for k in at] for c in extra]


def associated(terms: list[np.ndarray], y: np.ndarray, size: int, least: int = 2) -> np.ndarray:
    """The buckets with the largest chi-squared against y, ties by bucket."""
    if not len(terms):
        return np.zeros(0, np.int64)
    lens = [len(t) for t in terms]
    flat = np.concatenate(terms) if sum(lens) else np.zeros(0, np.int64)
    n, pos = len(y), float(y.sum())
    seen = np.bincount(flat, minlength=BUCKETS).astype(float)
    hit = np.bincount(flat, weights=np.repeat(y, lens), minlength=BUCKETS)
    expect = seen * pos / max(n, 1)
    spread = seen * (1 - seen / max(n, 1)) * (pos / max(n, 1)) * (1 - pos / max(n, 1))
    chi = np.where((seen >= least) & (spread > 0), (hit - expect) ** 2 / np.maximum(spread, 1e-12), 0.0)
    order = np.lexsort((np.arange(BUCKETS), -chi))[:size]
    return np.sort(order[chi[order] > 0])


def interacting(terms: list[np.ndarray], y: np.ndarray, bars: tuple[float, ...], among: int = 2048, size: int = 64) -> list[np.ndarray]:
    """For each bar, buckets of the pairs that tell more together than by their parts: all pairs of the
    `among` most frequent buckets (in at most nine rows of ten) are counted, and those whose difference of
    differences in y's share is over sqrt(bar) times its deviation give their buckets, the strongest first,
    up to `size`; so a pair counts whose parts tell nothing alone. Rows with the same terms count once, or
    copies would look like pairs."""
    alike = {(t.tobytes(), v): k for k, (t, v) in reversed(list(enumerate(zip(terms, y.tolist()))))}
    once = sorted(alike.values())
    terms, y = [terms[k] for k in once], y[once]
    n = len(y)
    seen = np.bincount(np.concatenate(terms), minlength=BUCKETS) if n else np.zeros(BUCKETS, np.int64)
    order = np.lexsort((np.arange(BUCKETS), -seen))
    order = order[(seen[order] >= 16) & (seen[order] <= 0.9 * n)][:among]
    if len(order) < 2:
        return [np.zeros(0, np.int64) for _ in bars]
    both = np.zeros((len(order), len(order)), np.float32)
    hit = both.copy()
    for c in range(0, n, 1024):  # rows at a time, so that memory doesn't grow with them
        x = Rows(terms[c : c + 1024], order).dense()
        both += x.T @ x
        x = x[y[c : c + 1024] > 0]
        hit += x.T @ x
    one, yes, pos = np.diag(both).copy(), np.diag(hit).copy(), float(y.sum())
    cells = [(both, hit), (one[:, None] - both, yes[:, None] - hit), (one[None] - both, yes[None] - hit)]
    cells.append((n - one[:, None] - one[None] + both, pos - yes[:, None] - yes[None] + hit))
    enough = np.minimum.reduce([k for k, _ in cells]) >= 8
    gap = sum(sign * h / np.maximum(k, 1) for sign, (k, h) in zip((1, -1, -1, 1), cells))
    spread = pos / n * (1 - pos / n) * sum(1 / np.maximum(k, 1) for k, _ in cells)
    strong = np.triu(np.where(enough, gap * gap / np.maximum(spread, 1e-12), 0.0), 1)
    out = []
    for bar in bars:
        i, j = np.nonzero(strong > bar)
        best = np.lexsort((j, i, -strong[i, j]))
        flat = np.stack([order[i[best]], order[j[best]]], axis=1).reshape(-1)
        _, first = np.unique(flat, return_index=True)
        out.append(np.sort(flat[np.sort(first)[:size]]))
    return out


class Rows:
    """0/1 rows over the chosen buckets, kept as the places of their ones."""

    def __init__(self, terms: list[np.ndarray], chosen: np.ndarray):
        place = np.full(BUCKETS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        own = [p[p >= 0] for p in (place[t] for t in terms)]
        self.width = len(chosen)
        self.set(np.concatenate([[0], np.cumsum([len(p) for p in own])]).astype(np.int64), np.concatenate(own) if own else np.zeros(0, np.int32))

    def set(self, offs, flat):
        self.offs, self.flat = offs, flat
        self.row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
        return self

    def __len__(self):
        return len(self.offs) - 1

    def take(self, at: np.ndarray) -> Rows:
        size = np.diff(self.offs)[at]
        offs = np.concatenate([[0], np.cumsum(size)])
        out = object.__new__(Rows)
        out.width = self.width
        return out.set(offs, self.flat[np.repeat(self.offs[at] - offs[:-1], size) + np.arange(offs[-1])])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], len(self))

    def back(self, g: np.ndarray) -> np.ndarray:
        """The transposed product."""
        return np.bincount(self.flat, g[self.row], self.width)

    def dense(self) -> np.ndarray:
        x = np.zeros((len(self), self.width), np.float32)
        x[self.row, self.flat] = 1.0
        return x


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
