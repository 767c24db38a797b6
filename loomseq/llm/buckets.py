"""Verified pairs inside buckets, as links per row and a forest, never as all pairs.

Rows (key, id, payload...) are shuffled by key and sorted, then streamed: a task holds one Arrow
batch and the unfinished bucket at its end, at most BLOCK rows of it. A larger bucket passes through
in numbered blocks; a second, otherwise empty round deals its pairs of blocks to tasks of their own,
so that a hot bucket is split over the cluster and no comparison is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomseq.llm.common import give_back, materialise

BLOCK, CHUNK = 4096, 1 << 16
OUT = "id bigint, links bigint, root bigint"
_LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes along the links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (label[i], label[j]):  # roots alone: a node moves with its root, or it would lose its tree
            np.minimum.at(new, at, low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == label).all():
            break
        label = new
        live = label[i] != label[j]
        i, j = i[live], j[live]
    return label


def _runs(key: np.ndarray) -> np.ndarray:
    """Bounds of equal neighbours."""
    return np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])


def _pairs(bounds: np.ndarray):
    """Index pairs i < j inside the runs, in chunks."""
    sizes = np.diff(bounds)
    small = sizes <= 64
    start, size = bounds[:-1][small], sizes[small]
    d = 1
    while len(size := size[(more := size > d)]):
        start = start[more]
        reps = size - d
        base = np.repeat(start - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps)
        i = base + np.arange(reps.sum())
        for c in range(0, len(i), CHUNK):
            yield i[c : c + CHUNK], i[c : c + CHUNK] + d
        d += 1
    for s, n in zip(bounds[:-1][~small], sizes[~small]):
        yield from _grid(np.arange(s, s + n), np.arange(s, s + n), True)


def _grid(left: np.ndarray, right: np.ndarray, same: bool):
    step = max(1, CHUNK // max(1, len(right)))
    for c in range(0, len(left), step):
        rows = left[c : c + step]
        i, j = np.repeat(rows, len(right)), np.tile(right, len(rows))
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        yield i, j


def _emit(batch: pa.RecordBatch, pairs, load, verify) -> pa.RecordBatch | None:
    """Links and roots of the rows of a batch that have a verified pair."""
    ids = np.asarray(batch.column("id"))
    payload, keys = load(batch), np.asarray(batch.column("key"))
    n, label = len(ids), None
    weigh = np.asarray(batch.column("weight")) if "weight" in batch.schema.names else np.ones(n, np.int64)
    links, li, lj = np.zeros(n, np.int64), [], []
    held = 0
    for i, j in pairs:
        ok = verify(payload, ids, keys, i, j)
        i, j = i[ok], j[ok]
        if len(i):
            for a, b in ((i, j), (j, i)):
                links += np.bincount(a, weights=weigh[b], minlength=n).astype(np.int64)
            li.append(i), lj.append(j)
            held += len(i)
            if held > 4 * n + CHUNK:  # fold what is known into one link a row
                label = forest(n, np.concatenate(li), np.concatenate(lj))
                k = np.nonzero(label != np.arange(n))[0]
                li, lj, held = [k], [label[k]], len(k)
    if not li:
        return None
    label = forest(n, np.concatenate(li), np.concatenate(lj))
    at = np.nonzero(links)[0]
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    least = np.full(n, n, np.int64)
    np.minimum.at(least, label, rank)
    root = ids[order][least[label[at]]]
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(root)], schema=_LINKS)


def linked(rows: DataFrame, load, verify, block: int = BLOCK) -> DataFrame:
    """(id, links, root) from buckets of rows (key bigint, id bigint, payload...).

    load(batch) makes numpy payloads; verify(payload, ids, keys, i, j) says which index pairs count.
    A pair must be accepted in one bucket only, if links are to count it once. The sum of links over
    an id's rows is its number of partners (of their weights, if rows have a weight column), and (id, root) are edges that join exactly what the
    pairs join. Ids must be distinct inside a bucket."""
    rest = [f for f in rows.schema.fields if f.name != "id"]
    kinds = to_arrow_schema(StructType(rest))
    target = pa.schema([*_LINKS, ("hot_block", pa.int64()), *kinds])
    schema = f"{OUT}, hot_block bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def hot(batch, first):
        n = batch.num_rows
        blocks = pa.array((np.arange(first, first + n)) // block)
        empty = pa.nulls(n, pa.int64())
        own = [batch.column(f.name).cast(f.type) for f in kinds]
        return pa.RecordBatch.from_arrays([batch.column("id"), empty, empty, blocks, *own], schema=target)

    def cool(found):
        n = found.num_rows
        return pa.RecordBatch.from_arrays(found.columns + [pa.nulls(n, pa.int64())] + [pa.nulls(n, f.type) for f in kinds], schema=target)

    def stream(batches):
        tail, passed, open_key = None, 0, None  # passed: rows of the open bucket that went out as blocks
        for b in batches:
            if not b.num_rows:
                continue
            if tail is not None:
                b = pa.Table.from_batches([tail, b]).combine_chunks().to_batches()[0]
            key = np.asarray(b.column("key"))
            bounds, tail = _runs(key), None
            if passed and key[0] == open_key:
                yield hot(b.slice(0, bounds[1]), passed)
                passed += bounds[1]
                bounds = bounds[1:]
                if len(bounds) == 1:
                    continue
            passed = 0
            last = bounds[-2]
            yield from part(b, bounds[:-1])
            if len(key) - last > block:
                yield hot(b.slice(last), 0)
                passed, open_key = len(key) - last, key[-1]
            else:
                tail = b.slice(last)
        if tail is not None:
            yield from part(tail, np.array([0, tail.num_rows]))
        tail = b = None
        give_back()

    def part(b, bounds):
        """Finished buckets; those over a block go out as blocks."""
        if len(bounds) < 2:
            return
        sizes = np.diff(bounds)
        for s, n in zip(bounds[:-1][sizes > block], sizes[sizes > block]):
            yield hot(b.slice(s, n), 0)
        starts = bounds[:-1][(sizes > 1) & (sizes <= block)]
        ends = bounds[1:][(sizes > 1) & (sizes <= block)]
        if len(starts):
            pick = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)])
            sub = b.take(pa.array(pick))
            found = _emit(sub, _pairs(_runs(np.asarray(sub.column("key")))), load, verify)
            if found is not None:
                yield cool(found)

    keyed = rows.repartition("key").sortWithinPartitions("key")
    first = materialise(keyed.mapInArrow(stream, schema))
    light = first.where("hot_block is null").select("id", "links", "root")
    large = first.where("hot_block is not null").drop("links", "root").withColumnRenamed("hot_block", "own")
    return light.unionByName(_dealt(large, rows.columns, load, verify))


def _dealt(large: DataFrame, names: list[str], load, verify) -> DataFrame:
    """Pairs of blocks of the large buckets; each row goes to every pair with its own block."""
    counts = large.groupBy("key").agg((F.max("own") + 1).alias("blocks"))
    dealt = (
        large.join(counts, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
        .withColumn("deal", F.xxhash64("key", "x", "y"))
    )
    cols = [*names, "own", "x", "y", "deal"]

    def compare(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bounds = _runs(np.asarray(t.column("deal")))
            for s, e in zip(bounds[:-2], bounds[1:-1]):
                yield from one(t.slice(s, e - s))
            held = [t.slice(bounds[-2])]
        for t in held:
            yield from one(t)
        held = t = b = None
        give_back()

    def one(t):
        own, x, y = (np.asarray(t.column(c)) for c in ("own", "x", "y"))
        left = np.nonzero(own == x)[0]
        found = _emit(t, _grid(left, left, True) if x[0] == y[0] else _grid(left, np.nonzero(own == y)[0], False), load, verify)
        if found is not None:
            yield found

    return dealt.select(*cols).repartition("deal").sortWithinPartitions("deal").mapInArrow(compare, OUT)
