"""Subword tokens (CNV2): byte pairs merged by rank, as a published vocabulary has them.

Text is cut into words by a pattern, in Spark; a word's bytes are then merged, always the pair of the lowest rank
first, until no neighbouring pair has one. A task encodes each word once for a batch and remembers it, up to a
bound; rows aren't shuffled. Vocabularies are read, not trained."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.operators.ngrams import parts

#: The public pattern of byte-level vocabularies, with Unicode white space.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """A letter for each byte: printable Latin-1 characters stand for themselves, others from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(own)))
    return [out[b] for b in range(256)]


@dataclass(frozen=True)
class Merges:
    """Ids of pieces, ranks of pairs, and what a word's last piece ends with."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    suffix: str = ""
    unknown: int = -1

    @classmethod
    def load(cls, path: str, unknown: int = -1) -> Merges:
        """From the driver's own file in the public JSON format; its size bounds what tasks are sent."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        return cls(dict(model["vocab"]), {p: k for k, p in enumerate(pairs)}, model.get("end_of_word_suffix") or "", unknown)

    def pieces(self, word: str) -> list[str]:
        """The word's pieces. Pairs wait in a heap, so a word of n bytes takes n log n steps."""
        letters = [_LETTERS[b] for b in word.encode("utf-8", "replace")]
        if letters:
            letters[-1] += self.suffix
        after, before, live = list(range(1, len(letters) + 1)), list(range(-1, len(letters) - 1)), letters[:]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(live) and (rank := self.ranks.get((live[i], live[j]))) is not None:
                heapq.heappush(heap, (rank, i, live[i], live[j]))

        for i in range(len(live) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if live[i] != left or j >= len(live) or live[j] != right:
                continue  # one of the two was merged meanwhile
            live[i], live[j], after[i] = left + right, None, after[j]
            if after[i] < len(live):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in live if x is not None]

    def encode(self, word: str) -> list[int]:
        return [self.ids.get(p, self.unknown) for p in self.pieces(word)]


_LETTERS = byte_letters()


def words_of(text: Column, pattern: str = WORDS) -> Column:
    """The text's words; white space stays with them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def encode(docs: DataFrame, merges: Merges, text: str = "text", key: str = "doc_id", words=words_of) -> DataFrame:
    """(key, ids array<int>): one row for each row of docs. A null or empty text has no ids."""
    sent = docs.sparkSession.sparkContext.broadcast(merges)
    base = docs.select(key, F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("words"))

    def run(batches: Iterable[pa.RecordBatch]):
        model, known = sent.value, {}
        for b in parts(batches):
            lists = b.column("words")
            coded = pc.dictionary_encode(lists.flatten())
            if len(known) > REMEMBERED:
                known.clear()
            own = []
            for w in coded.dictionary.to_pylist():
                got = known.get(w)
                if got is None:
                    got = known[w] = model.encode(w)
                own.append(got)
            by_word = pa.array(own, pa.list_(pa.int32())).take(coded.indices)
            ends = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.cast(pc.list_value_length(lists), pa.int64()))])
            sizes = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.cast(pc.list_value_length(by_word), pa.int64()))])
            ids = pa.ListArray.from_arrays(pc.cast(sizes.take(ends), pa.int32()), by_word.flatten())
            yield pa.RecordBatch.from_arrays([b.column(key), ids], names=[key, "ids"])

    return base.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>")
