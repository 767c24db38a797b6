"""Near copies: Jaccard similarity of 0.8 or more over the sets of five-word shingles.

op2's fingerprint can't find these: at 0.8 about 10 of its 64 bits differ, give or take 3, and a budget
of 17 bits has no selective segments. So candidates come from bands of minima over the same XXH64
shingles: sets meet if all ROWS minima of one of BANDS bands agree, which two sets of similarity s miss
with chance (1 - s**ROWS)**BANDS, 3 in a million at 0.8. Pairs that meet are compared exactly, by whole
sets. Copies link over components, and one row of each stays.

Words are those of simhash.hashes(); a text below five words is one shingle. Null and wordless texts are
copies of each other. Equal sets enter the search once. The smallest doc_id stays, nulls last, and of
rows that share it the smallest hash of the row; so rows without an id and different texts under one id
are kept like others, and reruns agree. An empty table gives an empty result; all columns pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm.buckets import linked
from loomseq.llm.common import components, map_batches, materialise, named_rows, texts_of
from loomseq.llm.simhash import hashes

WIDTH, BANDS, ROWS, SEED = 5, 24, 4, 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
BLOCK, _STEP, _VALUES = 1024, 2048, 1 << 20
_DRAW = np.random.default_rng(SEED)
_A = _DRAW.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _DRAW.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of shingle hashes."""
    return np.unique(np.array(hashes(text, WIDTH), dtype=np.uint64))


def bands(s: np.ndarray) -> list[int]:
    """A key for each band, none for the empty set; a clash of keys only adds a candidate."""
    if not len(s):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for c in range(0, len(s), _STEP):
        low = np.minimum(low, (s[c : c + _STEP, None] * _A + _B).min(0))
    return [xxhash.xxh3_64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(low.reshape(BANDS, ROWS))]


def nodes_of(docs: DataFrame) -> DataFrame:
    """(id, head, bands): each distinct set, by a digest, with its first row."""

    def run(b: pa.RecordBatch):
        sets = [shingles(t) for t in texts_of(b)]
        return {
            "doc_id": b.column("doc_id"), "row": b.column("_row"),
            "id": [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], "bands": [bands(s) for s in sets],
        }

    rows = map_batches(docs.select("doc_id", "text", "_row"), run, "doc_id bigint, row bigint, id bigint, bands array<bigint>")
    head = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row"))
    return rows.groupBy("id").agg(head.alias("head"), F.first("bands").alias("bands"))


def candidates(nodes: DataFrame) -> DataFrame:
    """(key, id) of the buckets with several sets; of buckets with the same sets, one."""
    banded = nodes.select("id", F.explode("bands").alias("key"))
    counted = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("mark"))
    several = counted.where("n > 1").groupBy("n", "mark").agg(F.min("key").alias("key")).select("key")
    return banded.join(several, "key").select("key", "id")


def _load(b: pa.RecordBatch):
    column = b.column("shingles")
    size = np.asarray(pc.list_value_length(column)).astype(np.int64)
    return np.asarray(column.flatten()).view(np.uint64), np.cumsum(size) - size, size, np.arange(len(size))


def _common(flat, start, size, a: int, js: np.ndarray) -> np.ndarray:
    """Number of shingles that row a shares with each of the rows js."""
    own, out = flat[start[a] : start[a] + size[a]], []
    ends = np.cumsum(size[js])
    for part in np.split(js, np.nonzero(np.diff(ends // _VALUES))[0] + 1):
        n = size[part]
        first = np.cumsum(n) - n
        values = flat[np.repeat(start[part] - first, n) + np.arange(n.sum())]
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        out.append(np.add.reduceat((own[at] == values).astype(np.int64), first))
    return np.concatenate(out)


def _verify(payload, ids, keys, i, j):
    """Whole sets compared. A pair that accepted pairs of this batch already join needs no comparison;
    so a group of near copies costs about one for each member."""
    flat, start, size, label = payload
    ok = np.zeros(len(i), bool)
    at = np.nonzero(DEN * np.minimum(size[i], size[j]) >= NUM * np.maximum(size[i], size[j]))[0]
    at = at[np.argsort(i[at], kind="stable")]
    for group in np.split(at, np.nonzero(np.diff(i[at]))[0] + 1):
        if not len(group):
            continue
        a = i[group[0]]
        group = group[label[j[group]] != label[a]]
        if not len(group):
            continue
        js = j[group]
        both = _common(flat, start, size, a, js)
        hit = DEN * both >= NUM * (size[a] + size[js] - both)
        if hit.any():
            ok[group[hit]] = True
            label[np.isin(label, label[js[hit]])] = label[a]
    return ok


def heads(docs: DataFrame) -> DataFrame:
    """(id, component, head) for each distinct set of the rows of named_rows()."""
    nodes = materialise(nodes_of(docs))
    rows = materialise(candidates(nodes))
    wanted = nodes.join(rows.select("id").distinct(), "id", "left_semi").select("id", F.col("head.row").alias("_row"))

    def run(b: pa.RecordBatch):
        return {"id": b.column("id"), "shingles": [shingles(t).view(np.int64) for t in texts_of(b)]}

    # Rows that repeat a whole row give the same set again.
    texts = docs.select("text", "_row").join(wanted, "_row").select("id", "text")
    sets = map_batches(texts, run, "id bigint, shingles array<bigint>").dropDuplicates(["id"])
    found = linked(rows.join(sets, "id").select("key", "id", "shingles"), _load, _verify, block=BLOCK)
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"), "head")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies."""
    named = named_rows(docs)
    keep = heads(named).groupBy("component").agg(F.min("head").alias("head")).select(F.col("head.row").alias("_row"))
    return named.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
