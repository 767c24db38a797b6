"""Dictionary matching of token n-grams (JOIN1-3, AGG1-2, SRT1-3, WIN2, CMP1).

The dictionary is joined as a broadcast table. Its size is bounded by MAX_BROADCAST_ROWS: with a larger one, windows
become 64-bit keys, a Bloom filter of the dictionary's keys drops what can't match, and only the rest is shuffled.
A dictionary of unknown size is never sent whole, nor its filter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.functions.sequence import words
from loomseq.operators import bloom
from loomseq.plans.scratch import fixed, give_back

#: About 50 MB of short strings. The published dictionary has 162,708 entries.
MAX_BROADCAST_ROWS = 500_000


def windows(docs: DataFrame, tokens: str, low: int, high: int, key: str = "doc_id") -> DataFrame:
    """Every run of low..high tokens as (key, start, len, ngram). Only runs that fit are made."""
    longest = F.least(F.lit(high), F.size("tokens") - F.col("start"))
    lists = words(F.col(tokens)) if dict(docs.dtypes)[tokens] == "string" else F.col(tokens)
    return (
        docs.select(key, lists.alias("tokens"))
        .where(F.size("tokens") >= low)
        .select(key, "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - low)).alias("start"))
        .select(key, "tokens", "start", F.explode(F.sequence(F.lit(low), longest)).alias("len"))
        .select(key, "start", "len", F.array_join(F.slice("tokens", F.col("start") + 1, F.col("len")), " ").alias("ngram"))
    )


#: Rows of a token column that are looked at together.
ROWS = 1_000


def parts(batches):
    """ROWS rows at a time. What Arrow and malloc hold in reserve goes back between batches."""
    for whole in batches:
        for c in range(0, whole.num_rows, ROWS):
            yield whole.slice(c, ROWS)
        whole = None
        give_back()


def split(column: pa.Array, most: int | None = None) -> tuple[pa.Array, np.ndarray]:
    """Flat tokens of a column, and their number of each row, of each row the first `most`. Texts are split here as words()
    does, so that tokens don't travel to Spark's rows and back: str.split() separates on the same characters."""
    if pa.types.is_string(column.type):
        lists = [t.split(None, -1 if most is None else most)[:most] if t else [] for t in column.to_pylist()]
        return pa.array([t for x in lists for t in x], pa.string()), np.fromiter(map(len, lists), np.int64, len(lists))
    if most is not None:
        column = pc.list_slice(column, 0, most)
    return column.flatten(), np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)


def slices(batches, tokens: str, most: int | None = None):
    """(rows, their flat tokens, number of tokens of each row), see split()."""
    for b in parts(batches):
        yield b, *split(b.column(tokens), most)


def _room(sizes: np.ndarray) -> np.ndarray:
    """For each token the number of tokens from it to the end of its row."""
    ends = np.cumsum(sizes)
    return np.repeat(ends, sizes) - np.arange(ends[-1] if len(ends) else 0)


#: Bits of a window's bucket: a range and a place in it. Ranges are what a shuffle deals, so many that one of them is small.
RANGES, PLACES = 1 << 10, 1 << 24
#: Buckets that a task gathers and counts before it sends them.
GATHERED = 1 << 22


def _hashes(flat: pa.Array) -> np.ndarray:
    """64 bits for each token."""
    coded = pc.dictionary_encode(flat)
    own = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False)
    return own[np.asarray(coded.indices)]


def _joined(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64 bits for windows that are one token longer than those before."""
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ last
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _buckets(keys: np.ndarray) -> np.ndarray:
    """34 bits of a window's hash."""
    return (keys >> np.uint64(30)).view(np.int64)


def _among(known: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which buckets are in a sorted array."""
    if not len(known):
        return np.zeros(len(bucket), bool)
    return known[np.minimum(np.searchsorted(known, bucket), len(known) - 1)] == bucket


def _likely(flat: pa.Array, sizes: np.ndarray, low: int, high: int, pairs: np.ndarray):
    """(n, starts, buckets) of the windows of n tokens all of whose neighbours are in the sorted buckets given."""
    if len(flat) < 2:
        return
    room, own = _room(sizes), _hashes(flat)
    keys = _joined(own[:-1], own[1:])
    good = _among(pairs, _buckets(keys))
    fits = np.ones(len(flat), bool)
    for n in range(2, min(high, len(flat)) + 1):
        if n > 2:
            keys = _joined(keys[:-1], own[n - 1 :])
        # A window of n tokens: one of n - 1, and its last two are neighbours of a likely bucket.
        fits[: len(flat) - n + 1] &= good[n - 2 :]
        fits[len(flat) - n + 1 :] = False
        starts = np.nonzero(fits & (room >= n))[0]
        if n >= low and len(starts):
            yield n, starts, _buckets(keys[starts])


def _planes(x: np.ndarray) -> bytes:
    """Small numbers by their lowest bytes, their next ones and so on: zeros stand together, and a shuffle packs them."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and the sum of its counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    new = np.nonzero(np.diff(key, prepend=-1))[0]
    return key[new], np.add.reduceat(count[order], new) if len(new) else count


def _counts(docs: DataFrame, tokens: str, made, least: int = 1) -> DataFrame:
    """(bucket, n): how often each bucket occurs, from `least` on; made(flat tokens, sizes) gives buckets. A null bucket
    says that a token is null or has a blank, so that different windows may give one string.

    Tasks send what they counted as one row for each range of buckets: differences of the sorted places and counts, about
    two bytes a bucket where a row of its own takes eight."""

    def packed(keys, counts):
        ends = np.searchsorted(keys, np.arange(RANGES + 1) * PLACES)
        full = np.nonzero(np.diff(ends))[0]
        places = [_planes(np.diff(keys[ends[r] : ends[r + 1]] - r * PLACES, prepend=0)) for r in full]
        numbers = [_planes(counts[ends[r] : ends[r + 1]]) for r in full]
        return pa.RecordBatch.from_pydict({"range": pa.array(full, pa.int32()), "places": pa.array(places, pa.binary()), "counts": pa.array(numbers, pa.binary())})

    def sent(batches):
        keys, counts = [], []
        for _, flat, sizes in slices(batches, tokens):
            if flat.null_count or pc.any(pc.match_substring(flat, " ")).as_py():
                yield pa.RecordBatch.from_pydict({"range": pa.array([-1], pa.int32()), "places": pa.array([b""]), "counts": pa.array([b""])})
                continue
            for bucket in made(flat, sizes):
                keys.append(bucket), counts.append(np.ones(len(bucket), np.int64))
            if sum(map(len, keys)) >= GATHERED:
                key, count = _summed(keys, counts)
                keys, counts = [key], [count]
                if len(key) > GATHERED // 2:
                    yield packed(key, count)
                    keys, counts = [], []
        if keys:
            yield packed(*_summed(keys, counts))

    def total(r, rows):
        if r < 0:
            return pa.RecordBatch.from_pydict({"bucket": pa.array([None], pa.int64()), "n": pa.array([len(rows)], pa.int64())})
        key, count = _summed([r * PLACES + np.cumsum(_numbers(p)) for p, _ in rows], [_numbers(c) for _, c in rows])
        enough = count >= least
        return pa.RecordBatch.from_pydict({"bucket": pa.array(key[enough], pa.int64()), "n": pa.array(count[enough], pa.int64())})

    def met(batches):
        at, rows = None, []
        for b in batches:
            for r, *row in zip(*(b.column(c).to_pylist() for c in ("range", "places", "counts"))):
                if r != at and rows:
                    yield total(at, rows)
                    rows = []
                at = r
                rows.append(row)
        if rows:
            yield total(at, rows)
        give_back()

    ranged = docs.select(tokens).mapInArrow(sent, "range int, places binary, counts binary")
    return ranged.repartition("range").sortWithinPartitions("range").mapInArrow(met, "bucket bigint, n bigint")


def _strings(flat: pa.Array, starts: np.ndarray, n: int) -> pa.Array:
    """The windows of n tokens at starts, as array_join() makes them."""
    parts = [flat.take(pa.array(starts + k)) for k in range(n)]
    return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def _pair_counts(docs: DataFrame, tokens: str, least: int = 1) -> DataFrame:
    """(bucket, n): neighbours, counted by buckets, see _counts()."""

    def made(flat, sizes):
        if len(flat) > 1:
            own = _hashes(flat)
            yield _buckets(_joined(own[:-1], own[1:]))[_room(sizes)[:-1] > 1]

    return _counts(docs, tokens, made, least)


def _window_counts(docs: DataFrame, tokens: str, low: int, high: int, pairs: np.ndarray, least: int) -> DataFrame:
    """(bucket, n): windows all of whose neighbours are in the buckets given, counted by buckets of their own."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(pairs))
    return _counts(docs, tokens, lambda flat, sizes: (b for _, _, b in _likely(flat, sizes, low, high, sent.value)), least)


def _likely_counts(docs: DataFrame, tokens: str, low: int, high: int, likely: np.ndarray, own: np.ndarray | None = None) -> DataFrame:
    """(ngram, n): how often each n-gram occurs whose neighbours are all in likely buckets, and which is in one of its own
    buckets if these are given; by string, so a clash of hashes only adds an n-gram."""
    sent = docs.sparkSession.sparkContext.broadcast((np.sort(likely), None if own is None else np.sort(own)))

    def run(batches):
        pairs, known = sent.value
        for _, flat, sizes in slices(batches, tokens):
            made = []
            for n, starts, bucket in _likely(flat, sizes, low, high, pairs):
                made.append(_strings(flat, starts if known is None else starts[_among(known, bucket)], n))
            if made:
                counted = pc.value_counts(pa.chunked_array(made))
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["ngram", "n"])

    return docs.select(tokens).mapInArrow(run, "ngram string, n bigint").groupBy("ngram").agg(F.sum("n").alias("n"))


def _fullest(counts: DataFrame, size: int, least: int) -> tuple[np.ndarray, int] | None:
    """The fullest buckets, `size` at most, and the least count from which on all are among them; None where a
    bucket is null."""
    # At most size + 1 rows of 16 bytes.
    rows = counts.orderBy(F.col("bucket").isNotNull(), F.desc("n")).limit(size + 1).toArrow()
    bucket, n = rows.column("bucket").combine_chunks(), np.asarray(rows.column("n"))
    if bucket.null_count:
        return None
    bar = int(n.min()) + 1 if len(n) > size else least
    return np.asarray(bucket)[n >= bar], bar


def _top(counts: DataFrame, size: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "ngram").limit(size)


def top_counts(docs: DataFrame, tokens: str, low: int, high: int, min_count: int, size: int) -> DataFrame:
    """(ngram, n): the size most frequent n-grams with at least min_count occurrences, ties by string.

    An n-gram occurs no oftener than any two neighbours in it. So neighbours are counted first, by buckets of a hash, and
    then windows all of whose neighbours are in one of the `size` fullest buckets, by buckets as well. Only n-grams of the
    fullest of these are shuffled as strings. If `size` of them occur as often as the least of these buckets, no
    other can be among the result. If not (most counts are alike), all windows with likely neighbours are shuffled, and if
    that isn't enough, or a token has a blank or is null, all windows."""
    pairs = _fullest(_pair_counts(docs, tokens, min_count), size, min_count) if low >= 2 else None
    if pairs:
        # A quarter more than wanted, as n-grams that share a bucket count as one.
        own = _fullest(_window_counts(docs, tokens, low, high, *pairs), size + size // 4, pairs[1])
        for known, least in (own, (None, pairs[1])):
            counts = _likely_counts(docs, tokens, low, high, pairs[0], known)
            top = fixed(_top(counts.where(F.col("n") >= least), size))
            if least == min_count or top.count() == size:
                return top
    every = windows(docs, tokens, low, high).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    return fixed(_top(every.where(F.col("n") >= min_count), size))


def corpus_dictionary(docs: DataFrame, tokens: str, low: int, high: int, min_count: int, size: int) -> DataFrame:
    """The size most frequent n-grams with at least min_count occurrences, ties by string;
    ids count from 1. The rank is taken over at most `size` rows, which are written once."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "ngram"))
    return top_counts(docs, tokens, low, high, min_count, size).select("ngram", rank.cast("int").alias("ngram_id"))


def hits(docs: DataFrame, tokens: str, dictionary: DataFrame, low: int, high: int, key: str = "doc_id", dictionary_rows: int | None = None) -> DataFrame:
    """Matches as (key, ngram, ngram_id, start, end), half-open and 0-based.

    dictionary_rows is a proven bound of the dictionary's size; only with one that is small enough
    is the dictionary broadcast. With a larger bound, see filtered_windows(); without one, all windows are shuffled."""
    small = dictionary_rows is not None and dictionary_rows <= MAX_BROADCAST_ROWS
    if small:
        found = windows(docs, tokens, low, high, key).join(F.broadcast(dictionary), "ngram")
    else:
        found = filtered_windows(docs, tokens, dictionary, low, high, key, dictionary_rows).join(keyed(dictionary), ["_key", "ngram"])
    return (
        found.select(key, "ngram", "ngram_id", "start", (F.col("start") + F.col("len")).cast("int").alias("end"))
    )


def keyed(dictionary: DataFrame) -> DataFrame:
    """The dictionary with its windows' 64-bit keys: a hash of the tokens' hashes."""
    return dictionary.withColumn("_key", F.xxhash64(F.transform(F.split("ngram", " "), lambda t: F.xxhash64(t))))


def filtered_windows(docs: DataFrame, tokens: str, dictionary: DataFrame, low: int, high: int, key: str = "doc_id", dictionary_rows: int | None = None) -> DataFrame:
    """(key, start, len, _key, ngram): windows that may be in a dictionary of any size.

    Tokens are hashed once for each row, a window's key is the hash of its part of these, and the string is made
    for those alone that the filter lets pass; the join compares it. Without a bound of the dictionary's rows they
    are counted. Beyond bloom.MAX_WORDS there is no filter, and all windows are shuffled."""
    longest = F.least(F.lit(high), F.size("tokens") - F.col("start"))
    hashed = docs.select(key, F.col(tokens).alias("tokens"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("hashes"))
    each = (
        hashed.where(F.size("tokens") >= low)
        .select(key, "tokens", "hashes", F.explode(F.sequence(F.lit(0), F.size("tokens") - low)).alias("start"))
        # What a window needs of its row; the whole arrays would be copied for each.
        .select(key, "start", F.slice("tokens", F.col("start") + 1, longest).alias("tokens"), F.slice("hashes", F.col("start") + 1, longest).alias("hashes"))
        .select(key, "start", "tokens", "hashes", F.explode(F.sequence(F.lit(low), F.size("tokens"))).alias("len"))
        .withColumn("_key", F.xxhash64(F.slice("hashes", F.lit(1), F.col("len"))))
    )
    words = None if dictionary_rows is None else bloom.words_for(dictionary_rows)
    if words:
        each = bloom.passing(each, "_key", bloom.build(keyed(dictionary), "_key", words), words)
    return each.select(key, "start", "len", "_key", F.array_join(F.slice("tokens", F.lit(1), F.col("len")), " ").alias("ngram"))


def group_positions(found: DataFrame, key: str = "doc_id", max_seq_length: int | None = None) -> DataFrame:
    """One row per (key, ngram_id): 1-based positions, and the first hit for ranking.

    Strings that share an id merge. Only the hits of one document meet, and a document has at most
    max_seq_length * (high - low + 1) of them."""
    span = F.sequence(F.col("start") + 1, F.col("end"))
    out = found.groupBy(key, "ngram_id").agg(
        F.min(F.struct("start", "end")).alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(span)))).alias("positions"),
    )
    if max_seq_length is not None:
        out = out.withColumn("positions", F.filter("positions", lambda p: p < max_seq_length))
    return out


def top_ngrams(grouped: DataFrame, cap: int, key: str = "doc_id") -> DataFrame:
    """Rank by the first hit (start, then length) and keep `cap` n-grams of a document."""
    order = Window.partitionBy(key).orderBy("first")
    return grouped.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= cap).drop("first")


def match(docs: DataFrame, tokens: str, dictionary: DataFrame, low: int, high: int, cap: int, max_seq_length: int, key: str = "doc_id", dictionary_rows: int | None = None) -> DataFrame:
    """(key, ngram_id, positions, rk): dictionary hits grouped, ranked and capped. Token arrays are
    dealt by key before windows are made, so that this one shuffle spreads the work evenly and serves
    grouping by (key, ngram_id) and ranking by key alike."""
    found = hits(docs.select(key, tokens).repartition(key), tokens, dictionary, low, high, key, dictionary_rows)
    return top_ngrams(group_positions(found, key, max_seq_length), cap, key)


def ranked_lists(flat: pa.Array, sizes: np.ndarray, names: pa.Array, first: np.ndarray, ids: np.ndarray, low: int, high: int, cap: int, max_seq_length: int) -> pa.Array:
    """What match() gives, as a list of (id, pos) in rank order for each row of an Arrow batch: the n-grams named, by
    strings, those that share an id merged, ranked by the first hit and capped. Name k has ids[first[k]:first[k + 1]]."""
    room, row = _room(sizes), np.repeat(np.arange(len(sizes)), sizes)
    at, gram, length = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(low, high + 1):
        starts = np.nonzero(room >= n)[0]
        found = np.asarray(pc.fill_null(pc.index_in(_strings(flat, starts, n), value_set=names), -1))
        hit = np.nonzero(found >= 0)[0]
        several = np.diff(first)[found[hit]]
        nth = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
        at.append(np.repeat(starts[hit], several)), gram.append(ids[np.repeat(first[found[hit]], several) + nth])
        length.append(np.full(len(nth), n))
    at, gram, length = np.concatenate(at), np.concatenate(gram), np.concatenate(length)
    order = np.lexsort((length, at, gram, row[at]))
    at, gram, length = at[order], gram[order], length[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(row[at]) != 0) | (np.diff(gram) != 0)
    group, head = np.cumsum(new) - 1, np.nonzero(new)[0]
    begins = np.cumsum(sizes) - sizes
    # Groups by row and first hit, and the first `cap` of each row.
    ranked = np.lexsort((length[head], at[head]))
    owner = row[at[head]][ranked]
    nth = np.arange(len(ranked)) - np.searchsorted(owner, owner)
    ranked = ranked[nth < cap]
    place = np.full(len(head), -1)
    place[ranked] = np.arange(len(ranked))
    # Places of the hits of each n-gram that stays, each once, in order.
    mine = place[group] >= 0
    start, n, to = (at - begins[row[at]])[mine] + 1, length[mine], place[group][mine]
    pos = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    width = int(pos.max()) + 1 if len(pos) else 1
    pairs = np.unique(np.repeat(to, n) * width + pos)
    pairs = pairs[pairs % width < max_seq_length]
    ends = np.searchsorted(pairs // width, np.arange(len(ranked) + 1)).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs % width).astype(np.int32)))
    items = pa.StructArray.from_arrays([pa.array(gram[head][ranked].astype(np.int32)), places], names=["id", "pos"])
    bounds = np.searchsorted(owner[nth < cap], np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), items)


def matrix_rows(matched: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sparse match matrix: (key, rk, pos). Swapping the last two columns transposes it."""
    return matched.select(key, "rk", F.explode("positions").alias("pos"))
