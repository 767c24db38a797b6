"""Harmonic packing of token sequences.

Documents are cut so that pieces fill reciprocal classes: class k has pieces of at most
CAPACITY // k tokens, and k of them make a sequence, whichever they are. Of what a whole number of
sequences leaves, the largest CAPACITY // k that fits is cut off, again and again, until a rest of
TAIL tokens or one that all but fills its class remains. Workers fill the sequences of their own
shard of a class without looking elsewhere; what is left over there is dealt to fewer shards, level by
level, until a class has had a single one; a level leaves about a thirtieth, so no shard grows with the
input. The last open sequence of each class, some hundred in all at any size, are packed together by
best fit. A sequence is padded to CAPACITY, or not at all where its length is a power of two.

A sequence's number is made of class, level, shard and place, each with bits of its own, and of nothing
for the last sequences. Pieces are dealt by a number that each is given when the pieces are written, so
rows without doc_id, or with the same, spread like others; which pieces meet thus depends on the table's
partitions. Null and empty texts have the end token alone, long ones are encoded whole. Rows that
repeat a doc_id are packed one by one. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.llm.common import map_batches, materialise
from loomseq.llm.wordpiece import encode

CAPACITY, END_ID, TAIL, SLACK = 4096, 2, 64, 0.01
#: Rows of a shard: so many, or so many full sequences if that is more.
SHARD_ROWS, SHARD_BINS = 256, 16
#: Bits of a sequence's number after the class: level, shard, place in the shard.
LEVEL_BITS, SHARD_BITS, BIN_BITS = 4, 34, 12


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > TAIL:
        own = capacity // (capacity // rest)  # the most that a piece of rest's class may have
        if own - rest <= SLACK * own:
            break
        k = -(-capacity // rest)
        out.append(capacity // k)
        rest -= capacity // k
    return out + [rest] if rest else out


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, k) for each piece, from whole texts."""

    def run(b: pa.RecordBatch):
        texts = b.column("text").to_pylist()
        end = np.array([END_ID], dtype="<u4").tobytes()
        rows = []
        for doc, ids in zip(b.column("doc_id").to_pylist(), encode(texts, tokenizer)):
            ids = memoryview(ids + end)
            total, start = len(ids) // 4, 0
            for n in cut(total):
                rows.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, CAPACITY // n))
                start += n
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "k")
        return dict(zip(names, zip(*rows)))

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, k int"
    return map_batches(docs.select("doc_id", "text"), run, schema)


def _number(k, level, shard, place):
    """Class, level, shard and place side by side, in at most 63 bits."""
    for value, bits in ((level, LEVEL_BITS), (shard, SHARD_BITS), (place, BIN_BITS)):
        k = k * (1 << bits) + value
    return k


def _fill(rows: DataFrame, level: int, counts: dict[int, int]) -> tuple[DataFrame, DataFrame, bool]:
    """Full sequences of each shard, the rows left over, and whether every class had one shard."""
    spark = rows.sparkSession
    shards = {k: max(1, n // max(SHARD_ROWS, SHARD_BINS * k)) for k, n in counts.items()}
    if level >= 1 << LEVEL_BITS or max(shards.values(), default=0) > 1 << SHARD_BITS:
        raise ValueError("more pieces than sequence numbers")
    table = spark.createDataFrame(list(shards.items()), "k int, shards bigint")  # a row for each class
    own = rows.join(F.broadcast(table), "k").withColumn("shard", F.expr(f"pmod(xxhash64(piece, {level}), shards)"))
    by = Window.partitionBy("k", "shard")
    ranked = (
        own.withColumn("rn", F.row_number().over(by.orderBy("piece"))).withColumn("n", F.count(F.lit(1)).over(by))
        .withColumns({"bin": F.expr("(rn - 1) div k"), "whole": F.expr("n div k")})
    )
    ranked = materialise(ranked)
    inside = Window.partitionBy("k", "shard", "bin").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    bins = F.when(F.col("bin") < 1 << BIN_BITS, F.col("bin")).otherwise(F.raise_error(F.lit("a shard has more sequences than numbers")))
    number = _number(F.col("k").cast("bigint"), F.lit(level), F.col("shard"), bins).cast("bigint")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = ranked.where("bin < whole").select(*cols, number.alias("sequence_id"), F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
    return full, ranked.where("bin >= whole").select(*cols, "k", "piece"), all(n == 1 for n in shards.values())


def _best_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best fit by falling length: each piece goes where it leaves the least room."""
    pdf = pdf.sort_values(["length", "piece"], ascending=[False, True]).reset_index(drop=True)
    rooms: list[tuple[int, int]] = []  # (room, sequence), sorted
    used, seq, off = [], [], []
    for n in pdf["length"].tolist():
        at = bisect.bisect_left(rooms, (n, -1))
        if at == len(rooms):
            used.append(0)
            s = len(used) - 1
        else:
            _, s = rooms.pop(at)
        seq.append(s)
        off.append(used[s])
        used[s] += n
        bisect.insort(rooms, (CAPACITY - used[s], s))
    return pdf.assign(sequence_id=seq, offset=off)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece."""
    left = materialise(pieces(docs, tokenizer).withColumn("piece", F.monotonically_increasing_id()))
    done, last, level = [], False, 0
    while not last:
        level += 1
        counts = {r.k: r.n for r in left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CAPACITY classes
        full, left, last = _fill(left, level, counts)
        done.append(full)
    # Fewer than k pieces of each class k are left: below 20,000 rows whatever the input.
    rest = left.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
        _best_fit, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    out = rest
    for d in done:
        out = out.unionByName(d)
    return out
