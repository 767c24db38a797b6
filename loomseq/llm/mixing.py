"""Mixing sources to target weights by cube-method balanced sampling.

A source's share of the total is its target; a document is taken floor(target / source size) times
and once more with the fractional rest as inclusion probability. The flight phase moves the
probabilities of three documents at a time along the null space of two constraints, tokens and
documents, until one becomes 0 or 1; so both totals stay exact. Blocks of at most BLOCK documents of
a source fly independently and leave two documents each, or more where a source has so few blocks that
LANDING wouldn't be left of them; these fly again in larger steps until a source has one block, each
source at its own level. Its flight stops at LANDING documents, and the subset of these with the least
token error lands. Sizes of other sources thus change a source's target, never its flight.

Draws come from the source and block, so reruns agree. A row's block comes from a hash of its doc_id and
text, however the table is dealt. Rows that agree in both more than SPREAD times are dealt by the number
that a row gets when the sizes are written instead, so that they don't meet in one block; these alone
depend on the table's partitions. Null sources come last in the order of weights and are one source; null
and empty texts have size 0, long ones are counted whole. An empty table gives an empty result. Rows that
repeat a doc_id, or have none, are separate documents. All columns pass through mix(), whatever their names.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm.common import map_batches, materialise, texts_of, unused
from loomseq.operators import scan, skew

#: The weights by source in code point order, the share of all sizes, the largest repeat.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK, LANDING, SEED, SPREAD = 1024, 16, 11, 64
_EPS = 1e-9
#: The largest number of sources whose facts are broadcast; those of more are joined by shuffle.
NEAR = 100_000


def _known(rows: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """rows with what `facts` says of their source (src), of which there are n. The facts of more than NEAR
    sources are shuffled, but for those that hold many rows."""
    if n <= NEAR:
        return rows.join(F.broadcast(facts), rows["source"].eqNullSafe(facts["src"])).drop("src")
    name = lambda c: [F.isnull(c).alias("_none"), F.coalesce(c, F.lit("")).alias("_src")]
    named = facts.select("*", *name("src")).drop("src")
    return skew.lookup(rows.select("*", *name("source")), named, ["_none", "_src"], "inner").drop("_none", "_src")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key) and columns other than text: words of the text, separated by ASCII
    white space, and a hash of doc_id and text."""
    keyed = docs.withColumn("key", F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text"))
    kept = keyed.drop("text").schema.fields

    def run(b: pa.RecordBatch):
        return {f.name: b.column(f.name) for f in kept} | {"size": [len(t.split()) for t in texts_of(b)]}

    return map_batches(keyed, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", size bigint")


def targets(totals: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Target by source: weighted shares of SHARE times the sum, none above MOST times its size;
    what exceeds that goes to the others by weight until none is above. The plain rule, for sources in a list."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: WEIGHTS[k % len(WEIGHTS)] for k, (s, _) in enumerate(order)}
    size = dict(order)
    out, left, free = {}, SHARE * sum(size.values()), [s for s, _ in order]
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > MOST * size[s]]
        if not above:
            return out | {s: unit * weight[s] for s in free}
        for s in above:
            out[s] = MOST * size[s]
            left -= out[s]
            free.remove(s)
    return out


def fly(size: list[int], p: list[float], rng: random.Random, stop: int) -> None:
    """Move p in place until at most `stop` (at least 2) entries lie strictly between 0 and 1."""
    queue = [k for k, x in enumerate(p) if 0.0 < x < 1.0][::-1]
    active: list[int] = []
    while True:
        while queue and len(active) < 3:
            active.append(queue.pop())
        if len(active) < 3 or len(active) + len(queue) <= stop:
            return
        a, b, c = active
        u = (float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b]))
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1.0 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, -p[k] / d), min(down, (p[k] - 1.0) / d)
        step = up if rng.random() * (up + down) < down else -down
        for k, d in zip(active, u):
            x = p[k] + step * d
            p[k] = 0.0 if x < _EPS else 1.0 if x > 1.0 - _EPS else x
        active = [k for k in active if 0.0 < p[k] < 1.0]


def land(size: list[int], p: list[float], goal: float) -> None:
    """Round what is left so that the chosen tokens come nearest to goal, then the documents."""
    at = [k for k, x in enumerate(p) if 0.0 < x < 1.0]
    if not at:
        return
    picks = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    fixed = sum(s * x for s, x in zip(size, p) if x == 1.0)
    error = np.abs(fixed + picks @ np.array([size[k] for k in at], dtype=float) - goal)
    docs = np.abs(picks.sum(1) - sum(p[k] for k in at))
    best = np.lexsort((docs, error))[0]
    for k, x in zip(at, picks[best]):
        p[k] = float(x)


def source_targets(totals: DataFrame) -> DataFrame:
    """totals (src, source_size) with `target`, as targets() has it. Sources stay distributed: a scan numbers
    them, and a round of resharing is one sum over all.

    The share of a unit of weight only grows from round to round, so it says by itself which sources it caps."""
    ranked = scan.prefix_sums(
        totals.withColumns({"none": F.isnull("src"), "one": F.lit(1)}), ["none", "src"], {"nth": "one"}
    ).withColumn("weight", F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("nth") % len(WEIGHTS)).cast("int")))
    ranked = materialise(ranked.drop("none", "one", "nth"))
    unit, before = 0.0, -1
    while True:
        above = F.lit(unit) * F.col("weight") > F.lit(MOST) * F.col("source_size")
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("source_size"))).alias("taken"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.count(F.when(above, 1)).alias("n"),
        ).head()
        if row.n == before or not row.weight:
            break
        before = row.n
        unit = max(unit, (SHARE * row["all"] - MOST * (row.taken or 0)) / row.weight)
    return ranked.withColumn("target", F.least(F.lit(unit) * F.col("weight"), F.lit(MOST) * F.col("source_size"))).drop("weight")


def _level(rows: DataFrame, level: int, n: int) -> DataFrame:
    """One flight over blocks of n sources at most; a source of one block lands."""
    # What a block's probabilities promise, where it is the whole source.
    facts = rows.groupBy(F.col("source").alias("src")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("shards"), F.sum(F.col("size") * F.col("p")).alias("goal"))
    salted = _known(rows, facts, n).withColumn("block", F.expr(f"pmod(xxhash64(deal, {level}), shards)"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["deal", "p", "row"]).reset_index(drop=True)
        size, p = pdf["size"].tolist(), pdf["p"].tolist()
        rng = random.Random(f"{SEED}:{level}:{pdf['source'][0]}:{pdf['block'][0]}")
        blocks = int(pdf["shards"][0])
        fly(size, p, rng, max(2, -(-LANDING // blocks)))
        if blocks == 1:
            land(size, p, pdf["goal"][0])
        return pdf.assign(p=p)[["row", "source", "size", "deal", "p"]]

    return salted.groupBy("source", "block").applyInPandas(run, "row bigint, source string, size bigint, deal bigint, p double")


def plan(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) for every row."""
    return _planned(materialise(sizes(docs.select("doc_id", "source", "text")).withColumn("row", F.monotonically_increasing_id()))).drop("row")


def _planned(rows: DataFrame) -> DataFrame:
    """plan() with the row's number, from written rows (row, doc_id, source, size, key)."""
    spark = rows.sparkSession
    want = source_targets(rows.groupBy(F.col("source").alias("src")).agg(F.sum("size").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    facts = materialise(want.withColumn("base", F.floor(rate).cast("int")).withColumn("p", rate - F.col("base")))
    sources = facts.count()
    known = _known(rows, facts, sources)
    live = known.where("p > 0 and p < 1").select("row", "source", "size", "p", "key")
    often = live.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPREAD).select("key", F.lit(True).alias("often"))
    live = live.join(often, "key", "left").select("row", "source", "size", F.when(F.col("often"), F.xxhash64("row")).otherwise(F.col("key")).alias("deal"), "p")
    done, level = [], 0
    while not live.isEmpty():
        flown = materialise(_level(live, level, sources))
        done.append(flown.where("p = 0 or p = 1").select("row", F.col("p").cast("int").alias("more")))
        live = flown.where("p > 0 and p < 1")
        level += 1
    settled = spark.createDataFrame([], "row bigint, more int")
    for d in done:
        settled = settled.unionByName(d)
    return known.join(settled, "row", "left").withColumn("times", F.col("base") + F.coalesce("more", F.lit(0))).select(
        "row", "doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).cast("bigint").alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the plan takes it. The rows are written once with a number, by
    which the plan finds them again, whatever their ids."""
    row, n, k = unused(docs.columns, "row", "n", "k")
    named = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    numbers = named.select(F.col(f"`{row}`").alias("row"), "doc_id", "source", "text")
    times = _planned(materialise(sizes(numbers))).where("times > 0").select(F.col("row").alias(row), F.col("times").alias(n))
    many = F.explode(F.sequence(F.lit(1), F.col(n))).alias(k)
    return named.join(times, row).select(*[F.col(f"`{c}`") for c in docs.columns], many).drop(k)
