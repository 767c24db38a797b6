"""Masked-language-model sampling (MSK1-MSK3), with draws that depend on the row alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.functions.draws import RowDraws, below, uniform, uniform_int
from loomseq.operators.batches import listed, lists, over

IGNORE = -100


def candidates(ids: Column, row: Column, specials: list[int], rate: float, seed: int) -> Column:
    """0-based positions drawn with the given rate among ids that aren't special."""
    picked = F.transform(
        ids, lambda t, i: F.when(~t.isin(specials) & below(seed, row, i, "select", rate), i)
    )
    return F.filter(picked, lambda p: p.isNotNull())


def candidate_rows(rows: DataFrame, ids: str, row: str, specials: list[int], rate: float, seed: int, pos: str = "pos") -> DataFrame:
    """candidates() as (row, pos), one row each: a position is a row before it is drawn, which compiles, where a
    function over an array doesn't."""
    each = rows.select(row, F.posexplode(ids).alias(pos, "_id"))
    return each.where(~F.col("_id").isin(specials) & below(seed, F.col(row), F.col(pos), "select", rate)).select(row, pos)


def closure(cand: Column, ngrams: Column) -> Column:
    """Fold over n-grams in rank order: one that touches a candidate makes all its positions
    candidates and goes. Later n-grams see what earlier ones added, not the other way round.

    ngrams: array<struct<id, pos array<int>>>. Returns struct<cand array<int>, removed array<int>>."""
    start = F.struct(cand.cast("array<int>").alias("cand"), F.array().cast("array<int>").alias("removed"))

    def step(acc, g):
        hit = F.arrays_overlap(acc["cand"], g["pos"])
        return F.struct(
            F.when(hit, F.array_union(acc["cand"], g["pos"])).otherwise(acc["cand"]).alias("cand"),
            F.when(hit, F.array_append(acc["removed"], g["id"])).otherwise(acc["removed"]).alias("removed"),
        )

    return F.aggregate(ngrams, start, step)


def masked_ids(ids: Column, cand: Column, row: Column, mask_id: int, vocab_size: int, seed: int) -> Column:
    """80 % mask id, 10 % a random id, 10 % unchanged, at candidate positions."""

    def one(t, i):
        u = uniform(seed, row, i, "branch")
        new = F.when(u < 0.8, F.lit(mask_id)).when(u < 0.9, uniform_int(seed, row, i, "replace", vocab_size)).otherwise(t)
        return F.when(F.array_contains(cand, i), new).otherwise(t)

    return F.transform(ids, one)


def labels_of(ids: Column, cand: Column) -> Column:
    """Original ids at candidate positions, IGNORE elsewhere."""
    return F.transform(ids, lambda t, i: F.when(F.array_contains(cand, i), t).otherwise(F.lit(IGNORE)))


def _folded(cand: list[int], ids: list[int], pos: list[list[int]], pad: int) -> tuple[list[int], set[int]]:
    """closure() of one row: candidates in order, and the ids that go."""
    every, gone = set(cand), set()
    for g, p in zip(ids, pos):
        if g != pad and not every.isdisjoint(p):
            every.update(p)
            gone.add(g)
    return sorted(every), gone


def mask_record(records: DataFrame, row: str, specials: list[int], mask_id: int, vocab_size: int, rate: float = 0.15, whole_ngrams: bool = True, pad_ngram_id: int = 0, seed: int = 42, made: tuple[str, ...] | None = None) -> DataFrame:
    """Records with input_ids and ngrams (array<struct<id,pos>>, in rank order) become masked:
    input_ids, labels, candidates, ngrams with those removed replaced by padding at the end.

    Rows are masked in Arrow batches: an expression over an array isn't compiled, and looked for each place among the
    candidates. made: the columns wanted of these four, beside those that stay as they are; all without it."""
    named = records.withColumn("_row", F.col(row).cast("string"))
    return over(named, masked("_row", specials, mask_id, vocab_size, rate, whole_ngrams, pad_ngram_id, seed, made)).drop("_row")


def masked(row: str, specials: list[int], mask_id: int, vocab_size: int, rate: float = 0.15, whole_ngrams: bool = True, pad_ngram_id: int = 0, seed: int = 42, made: tuple[str, ...] | None = None):
    """mask_record() as a step, see batches.py; row is a column of strings or integers."""
    changed = ["input_ids", *(["ngrams"] if whole_ngrams else []), "candidates", "labels"]
    wanted = [c for c in changed if made is None or c in made]

    def new_id(draws, place: int, old: int) -> int:
        u = draws.uniform(place, "branch")
        return mask_id if u < 0.8 else draws.uniform_int(place, "replace", vocab_size) if u < 0.9 else old

    def columns(b: pa.RecordBatch) -> dict:
        column = b.column("input_ids")
        flat, ends = lists(column)
        ids = np.asarray(flat)
        free = np.nonzero(~np.isin(ids, specials))[0]
        cuts = np.searchsorted(free, ends)
        if whole_ngrams:
            grams, gram_ends = lists(b.column("ngrams"))
            names = grams.field("id").to_pylist()
            spans, span_ends = lists(grams.field("pos"))
            spans, span_ends = spans.to_pylist(), span_ends.tolist()
        cands, sizes, places, news, order, removed = [], [], [], [], [], []
        for k, name in enumerate(b.column(row).cast(pa.string()).to_pylist()):
            begin, size = int(ends[k]), int(ends[k + 1] - ends[k])
            draws = RowDraws(seed, name)
            cand = draws.below((free[cuts[k] : cuts[k + 1]] - begin).tolist(), "select", rate)
            if whole_ngrams:
                own = range(gram_ends[k], gram_ends[k + 1])
                mine = [names[g] for g in own]
                cand, gone = _folded(cand, mine, [spans[span_ends[g] : span_ends[g + 1]] for g in own], pad_ngram_id)
                stay = [g for g, x in zip(own, mine) if x != pad_ngram_id and x not in gone]
                order += stay + [g for g, x in zip(own, mine) if x == pad_ngram_id or x in gone]
                removed += [False] * len(stay) + [x in gone for x in mine if x == pad_ngram_id or x in gone]
            cands += cand
            sizes.append(len(cand))
            inside = [p for p in cand if p < size]
            places += [begin + p for p in inside]
            if "input_ids" in wanted:
                news += [new_id(draws, p, x) for p, x in zip(inside, ids[[begin + p for p in inside]].tolist())]
        out = {"candidates": lambda: listed(np.concatenate([[0], np.cumsum(sizes)]), pa.array(cands, pa.int32()), column)}
        labels, changed_ids, at = np.full_like(ids, IGNORE), ids.copy(), np.array(places, np.int64)
        labels[at] = ids[at]
        out["labels"] = lambda: listed(ends, pa.array(labels), column)
        if "input_ids" in wanted:
            changed_ids[at] = news
        out["input_ids"] = lambda: listed(ends, pa.array(changed_ids), column)

        def left() -> pa.ListArray:
            taken = grams.take(pa.array(order, pa.int64()))
            none = pa.array(removed, pa.bool_())
            new_names = pc.if_else(none, pa.scalar(pad_ngram_id, taken.field("id").type), taken.field("id"))
            empty = pa.array([[]] * len(taken), taken.field("pos").type)
            new_pos = pc.if_else(none, empty, taken.field("pos"))
            return listed(gram_ends, pa.StructArray.from_arrays([new_names, new_pos], names=["id", "pos"]), b.column("ngrams"))

        out["ngrams"] = left
        return {c: out[c]() for c in wanted}

    def step(types):
        if types[row] not in ("string", "tinyint", "smallint", "int", "bigint"):
            raise ValueError("rows are named by strings or integers")
        kinds = types | {"candidates": "array<int>", "labels": types["input_ids"]}
        kept = [c for c in types if c not in changed]
        return lambda b: pa.RecordBatch.from_pydict({c: b.column(c) for c in kept} | columns(b)), {c: kinds[c] for c in [*kept, *wanted]}

    return step
