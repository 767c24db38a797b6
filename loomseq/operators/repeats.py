"""N-grams that occur twice or more in a corpus, and where (CMP1, JOIN1 beyond any bound of the dictionary).

The dictionary of these n-grams grows with the corpus, and so do the matches; neither is shuffled. Texts are written once as
blocks of ids. For each length, a block sends every window once, as 88 bits of hash, to the range of the hash; a range sees
which windows others have, too, and sends the block a bit for each. A window is asked for only if the two windows in
it that are one token shorter occur twice, so that longer ones are few. Strings are made for the matches alone, from the blocks.

Two different windows count as one only if 88 bits of hash agree, made from two hashes of each token: with 10 billion
different windows the chance that any two do is about 2 in 10 million."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.operators.ngrams import _joined, _numbers, _planes, _room, slices
from loomseq.plans.scratch import fixed_alone, give_back

#: Tokens of a block, which a task holds together with their windows of one length, and tokens of the input for each range.
BLOCK, RANGE = 1 << 19, 1 << 20
#: Matches of a batch.
SENT = 1 << 17
#: Bits of the second hash.
MORE = np.uint64((1 << 24) - 1)
_SECOND = "loomseq.repeats2"


def _sealed(**columns) -> bytes:
    """One row of named arrays, packed."""
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _opened(body: bytes) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(body).read_next_batch()
    return {name: row.column(name).flatten() for name in row.schema.names}


def blocks(docs: DataFrame, tokens: str, key: str) -> DataFrame:
    """(block, n, body): documents with about BLOCK tokens together, written once; a body holds keys, sizes, ids and their words."""

    def run(batches):
        began, made, held = TaskContext.get().partitionId() << 32, 0, []

        def block():
            flat = pa.concat_arrays([f for _, f, _ in held])
            coded = flat.dictionary_encode()
            ids = np.frombuffer(_planes(np.asarray(coded.indices).astype(np.int64)), np.uint8)
            sizes = np.concatenate([s for _, _, s in held])
            body = _sealed(keys=pa.concat_arrays([k for k, _, _ in held]), sizes=pa.array(sizes), ids=pa.array(ids), words=coded.dictionary)
            return pa.RecordBatch.from_pydict({"block": pa.array([began + made], pa.int64()), "n": pa.array([len(flat)], pa.int64()), "body": pa.array([body], pa.binary())})

        for b, flat, sizes in slices(batches, tokens):
            ends = np.cumsum(sizes)
            # Rows of long texts are cut apart before they are too many.
            cuts = [0, *(np.nonzero(np.diff(ends // BLOCK))[0] + 1), len(sizes)]
            for a, z in zip(cuts, cuts[1:]):
                before = ends[a] - sizes[a] if a < z else 0
                held.append((b.column(key).slice(a, z - a), flat.slice(before, sizes[a:z].sum()), sizes[a:z]))
                if sum(len(f) for _, f, _ in held) >= BLOCK:
                    yield block()
                    made, held = made + 1, []
        if held:
            yield block()
        give_back()

    return fixed_alone(docs.select(key, tokens).mapInArrow(run, "block bigint, n bigint, body binary"))


class _Windows:
    """The windows of a block by length, and which of them occur twice."""

    def __init__(self, body: bytes, low: int):
        parts = _opened(body)
        self.keys, self.words, self.low = parts["keys"], parts["words"], low
        self.sizes, self.ids = np.asarray(parts["sizes"]), _numbers(np.asarray(parts["ids"]).tobytes())
        self.room = _room(self.sizes)
        named = np.asarray(self.words.to_pylist(), dtype=object)
        self.own = [pd.util.hash_array(named, hash_key=k, categorize=False)[self.ids] if len(named) else np.zeros(0, np.uint64) for k in ("0123456789123456", _SECOND)]
        self.length, self.hashed, self.good = 1, list(self.own), None

    def asked(self, n: int):
        """(starts, order, new, hashes, more) of the windows of n tokens that may occur twice, see _grouped()."""
        while self.length < n:
            self.length += 1
            self.hashed = [_joined(h[:-1], o[self.length - 1 :]) for h, o in zip(self.hashed, self.own)]
        fits = self.room >= n
        if n > self.low:
            fits[:-1] &= self.good[:-1] & self.good[1:]
        starts = np.nonzero(fits)[0]
        hashes, more = self.hashed[0][starts], (self.hashed[1][starts] >> np.uint64(20)) & MORE
        order, new = _grouped(hashes, more)
        return starts, order, new, hashes, more

    def decide(self, n: int, twice: np.ndarray, places: np.ndarray | None):
        """`good` says at which places windows of n tokens occur twice, if these aren't known yet by the answers for the
        different windows that were asked for; n counts up from low."""
        if places is not None:
            self.good = places
            return
        starts, order, new, _, _ = self.asked(n)
        if len(twice) != new.sum():
            raise ValueError(f"{len(twice)} answers for {new.sum()} windows of {n} tokens")
        self.good = np.zeros(len(self.room), bool)
        self.good[starts[order]] = twice[np.cumsum(new) - 1]


def _grouped(hashes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by both, and where in it a pair differs from the one before."""
    order = np.argsort(hashes)
    for again in (False, True):
        if again:
            order = np.lexsort((more, hashes))
        a, b = hashes[order], more[order]
        same, new = np.ones(len(a), bool), np.ones(len(a), bool)
        same[1:], new[1:] = a[1:] == a[:-1], (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        same[:1] = False
        if not (same & new).any():
            break
    return order, new


def _ranges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges of sorted hashes, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _answered(rows) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Of each length, whether the different windows of a block occur twice, in order, and at which places if that is known."""
    out: dict[int, list] = {}
    places = {}
    for r in sorted(rows or [], key=lambda r: (r["length"], r["range"])):
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).view(bool)
        if r["range"] < 0:
            places[r["length"]] = bits
        else:
            out.setdefault(r["length"], []).append(bits)
    return {n: np.concatenate(x) for n, x in out.items()}, places


def _with(made: DataFrame, known: DataFrame | None) -> DataFrame:
    """Blocks with what is known of their windows."""
    if known is None:
        return made.select("body", "block", F.lit(None).cast("array<struct<length:int,range:int,n:int,bits:binary>>").alias("known"))
    each = known.groupBy("block").agg(F.collect_list(F.struct("length", "range", "n", "bits")).alias("known"))
    return made.join(each, "block").select("body", "block", "known")


def _visited(batches, low: int):
    for b in batches:
        for k in range(b.num_rows):
            yield b.column("block")[k].as_py(), _Windows(b.column("body")[k].as_py(), low), _answered(b.column("known")[k].as_py())
    give_back()


def _answers(made: DataFrame, known: DataFrame | None, low: int, n: int, ranges: int) -> DataFrame:
    """(block, length, range, n, bits): for each different window of n tokens of a block, whether it occurs twice anywhere.
    Ranges below zero have the places of the windows that are one token shorter, so that they aren't made out again."""

    def sent(batches):
        for block, w, (have, places) in _visited(batches, low):
            if n > low:
                if n - 1 not in have:  # none was asked for
                    continue
                for shorter in range(max(low, n - 2), n):
                    w.decide(shorter, have[shorter], places.get(shorter))
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array([-1 - (block ^ block >> 32) % ranges], pa.int32()), "block": pa.array([block], pa.int64()), "n": pa.array([len(w.good)], pa.int32()),
                    "hashes": pa.array([np.packbits(w.good).tobytes()], pa.binary()), "more": pa.array([b""], pa.binary()), "several": pa.array([b""], pa.binary()),
                })
            _, order, new, hashes, more = w.asked(n)
            firsts = np.nonzero(new)[0]
            h, m = hashes[order[firsts]], more[order[firsts]]
            several = np.diff(firsts, append=len(order)) > 1
            ends = np.searchsorted(_ranges(h, ranges), np.arange(ranges + 1))
            full = np.nonzero(np.diff(ends))[0]
            cuts = [slice(ends[r], ends[r + 1]) for r in full]
            # Differences of sorted hashes by their lowest bytes and so on: a shuffle packs the zeros.
            steps = [np.diff(h[c], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in cuts]
            yield pa.RecordBatch.from_pydict({
                "range": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int64()), "n": pa.array([c.stop - c.start for c in cuts], pa.int32()),
                "hashes": pa.array(steps, pa.binary()), "more": pa.array([m[c].view(np.uint8).reshape(-1, 8)[:, :3].T.tobytes() for c in cuts], pa.binary()),
                "several": pa.array([np.packbits(several[c]).tobytes() for c in cuts], pa.binary()),
            })

    def answers(rows, length, bits):
        kept = {c: pa.array([r[c] for r in rows], t) for c, t in (("block", pa.int64()), ("range", pa.int32()), ("n", pa.int32()))}
        return pa.RecordBatch.from_pydict(kept | {"length": pa.array([length] * len(rows), pa.int32()), "bits": pa.array(bits, pa.binary())})

    def total(rows):
        if rows[0]["range"] < 0:
            return answers(rows, n - 1, [r["hashes"] for r in rows])
        h = np.concatenate([np.cumsum(np.ascontiguousarray(np.frombuffer(r["hashes"], np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64) for r in rows])
        m = np.zeros((len(h), 4), np.uint8)
        m[:, :3] = np.concatenate([np.frombuffer(r["more"], np.uint8).reshape(3, -1).T for r in rows])
        times = 1 + np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=r["n"]) for r in rows])
        order, new = _grouped(h, m.view(np.uint32).ravel())
        sums = np.add.reduceat(times[order].astype(np.int64), np.nonzero(new)[0])
        twice = np.empty(len(h), bool)
        twice[order] = (sums > 1)[np.cumsum(new) - 1]
        ends = np.cumsum([0] + [r["n"] for r in rows])
        bits = [np.packbits(twice[a:z]).tobytes() for a, z in zip(ends, ends[1:])]
        return answers(rows, n, bits)

    def met(batches):
        at, rows = None, []
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                if row["range"] != at and rows:
                    yield total(rows)
                    rows = []
                at = row["range"]
                rows.append(row)
        if rows:
            yield total(rows)
        give_back()

    packed = _with(made, known).mapInArrow(sent, "range int, block bigint, n int, hashes binary, more binary, several binary")
    dealt = packed.repartition("range").sortWithinPartitions("range")
    return fixed_alone(dealt.mapInArrow(met, "block bigint, range int, n int, length int, bits binary"))


def hits(docs: DataFrame, tokens: str, low: int, high: int, most: int, key: str = "doc_id") -> DataFrame:
    """(key, ngram, start, end), half-open and 0-based: windows of low..high tokens within the first `most` tokens of a row
    that occur twice or more in the whole texts of all rows. `tokens` is a column of texts, split as words() does, so
    no token has a blank and different windows are different strings. Rows that share a key stay apart."""
    if dict(docs.dtypes)[tokens] != "string":
        raise ValueError(f"{tokens} must hold texts")
    made, known = blocks(docs, tokens, key), None
    count = made.agg(F.sum("n")).first()[0] or 0
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-count // RANGE))
    for n in range(low, high + 1):
        more = _answers(made, known, low, n, ranges)
        known = more if known is None else known.unionByName(more)
    kind = docs.schema[key].dataType.simpleString()

    def found(batches):
        for _, w, (have, places) in _visited(batches, low):
            row = np.repeat(np.arange(len(w.sizes)), w.sizes)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(w.sizes) - w.sizes, w.sizes)
            for n in range(low, high + 1):
                if n not in have:  # none was asked for
                    break
                w.decide(n, have[n], places.get(n))
                starts = np.nonzero(w.good & (pos + n <= most))[0]
                for c in range(0, len(starts), SENT):
                    some = starts[c : c + SENT]
                    parts = pa.array(pos[some], pa.int32()), pa.array(pos[some] + n, pa.int32())
                    grams = pc.binary_join_element_wise(*(w.words.take(pa.array(w.ids[some + k])) for k in range(n)), " ")
                    yield pa.RecordBatch.from_arrays([w.keys.take(pa.array(row[some])), grams, *parts], names=[key, "ngram", "start", "end"])

    return _with(made, known).mapInArrow(found, f"`{key}` {kind}, ngram string, start int, end int")
