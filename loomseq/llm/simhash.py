"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: 64 bits by majority vote over the XXH64 (seed 42) of word shingles. Two fingerprints
link at BUDGET or fewer differing bits. The 64 bits form a ring of SEGMENTS; if the whole ring has at
most BUDGET differences, some segment starts a chain whose first l segments hold at most
floor(l * BUDGET / SEGMENTS) of them, for every l: 0, 1, 2, 3. Segment and next segment (no and one
difference) make the bucket key; the rest of the chain is checked before the full distance.

Nulls and empty texts have fingerprint zero and link like any other. Repeated rows and exact copies
share a fingerprint and enter the search once. Different texts that share a doc_id are linked each by its
own fingerprint. A row without doc_id links others, and has a component if any row of it has an id; dedup()
drops it. An empty table gives an empty result. Other columns
of the table are ignored by fingerprints() and kept by dedup().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm.buckets import linked
from loomseq.llm.common import components, map_batches, materialise, named_rows, texts_of
from loomseq.operators import skew

SHINGLE, SEED, BUDGET = 4, 42, 4
#: (first bit, width) around the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_VOTES = 1 << 17


def hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of the word shingles; a shorter text is one shingle, no word gives none."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())]


def votes(h: list[int]) -> np.ndarray:
    """Set bits by place, counted in blocks so that a long text needs bounded memory."""
    total = np.zeros(64, np.int64)
    for c in range(0, len(h), _VOTES):
        part = np.array(h[c : c + _VOTES], dtype=np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    h = hashes(text)
    return int(np.packbits(votes(h) * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint): the fingerprint of each row's text, as signed 64 bits."""

    def run(b: pa.RecordBatch):
        fps = np.array([fingerprint(t) for t in texts_of(b)], dtype=np.uint64)
        return {"doc_id": b.column("doc_id"), "fp": pa.array(fps.view(np.int64))}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, fp bigint")


def ring(fp: np.ndarray) -> np.ndarray:
    """Columns of segment values."""
    u = fp.view(np.uint64)
    return np.stack([(u >> np.uint64(a)) & np.uint64((1 << w) - 1) for a, w in SEGMENTS], axis=1)


def bucket_rows(fps: DataFrame) -> DataFrame:
    """(key, id, fp, probe) from (id, fp): a home row for each chain start, and a probe row for each
    zero bit of the second segment, set to one. Of two fingerprints that differ there in one bit,
    exactly one has the zero, so one probe meets the other's home."""

    def run(b: pa.RecordBatch):
        fp, ids = np.asarray(b.column("fp")), np.asarray(b.column("id"))
        seg, n = ring(fp), len(SEGMENTS)
        for k in range(n):
            first, second = seg[:, k], seg[:, (k + 1) % n]
            base = (np.uint64(k) << np.uint64(32)) | (first << np.uint64(16))
            yield {"key": (base | second).view(np.int64), "id": ids, "fp": fp, "probe": np.zeros(len(fp), bool)}
            for bit in range(SEGMENTS[(k + 1) % n][1]):
                at = np.nonzero((second >> np.uint64(bit)) & np.uint64(1) == 0)[0]
                if len(at):
                    flipped = (base | second | np.uint64(1 << bit))[at]
                    yield {"key": flipped.view(np.int64), "id": ids[at], "fp": fp[at], "probe": np.ones(len(at), bool)}

    return map_batches(fps.select("id", "fp"), run, "key bigint, id bigint, fp bigint, probe boolean", rows=4096)


def _load(b: pa.RecordBatch):
    fp = np.asarray(b.column("fp"))
    return fp.view(np.uint64), ring(fp), b.column("probe").to_numpy(zero_copy_only=False)


def _verify(payload, ids, keys, i, j):
    """Chain prefixes of three and four segments, then the whole distance."""
    fp, seg, probe = payload
    ok = ~(probe[i] & probe[j])
    start = keys[i] >> 32
    n = len(SEGMENTS)
    spent = np.zeros(len(i), np.int64)
    for step in range(n - 1):
        at = (start + step) % n
        spent += np.bitwise_count(seg[i, at] ^ seg[j, at])
        ok &= spent <= (step + 1) * BUDGET // n
    at = np.nonzero(ok)[0]
    ok[at] = np.bitwise_count(fp[i[at]] ^ fp[j[at]]) <= BUDGET
    return ok


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, itself included.

    Fingerprints are the nodes, so rows are linked by their own texts alone, also where different texts share an
    id, and rows without an id link others; a component without any id has none."""
    prints = materialise(fingerprints(docs))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = linked(bucket_rows(distinct.select(F.col("fp").alias("id"), "fp")), _load, _verify)
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    near = materialise(distinct.join(roots.withColumnRenamed("id", "fp"), "fp"))
    least = near.groupBy("root").agg(F.min("least").alias("component_id"))
    named = skew.lookup(near.select("fp", "root"), least, ["root"]).select("fp", "component_id")
    alone = distinct.join(near.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return skew.lookup(prints, materialise(named.unionByName(alone)), ["fp"]).select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows whose doc_id is their component's smallest; of rows that repeat it, one stays."""
    keep = classes(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def dedup_rows(docs: DataFrame) -> DataFrame:
    """One row of each component, the smallest doc_id, nulls last, and of rows that share it the smallest hash of the row.
    Unlike dedup(), rows without an id and different texts under one id are kept like others."""
    named = named_rows(docs)

    def run(b: pa.RecordBatch):
        fps = np.array([fingerprint(t) for t in texts_of(b)], dtype=np.uint64)
        return {"doc_id": b.column("doc_id"), "row": b.column("_row"), "fp": pa.array(fps.view(np.int64))}

    prints = map_batches(named.select("doc_id", "text", "_row"), run, "doc_id bigint, row bigint, fp bigint")
    head = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row"))
    distinct = materialise(prints.groupBy("fp").agg(head.alias("head")))
    found = linked(bucket_rows(distinct.select(F.col("fp").alias("id"), "fp")), _load, _verify)
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "fp")
    least = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("head").alias("head"))
    keep = least.select(F.col("head.row").alias("_row"))
    return named.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
