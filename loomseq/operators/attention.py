"""Attention, fusion, embedding lookup and losses on keyed rows (JOIN4-6, AGG11, AGG13, WIN3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.functions.vectors import add, alibi_bias, dot, log_softmax_at
from loomseq.operators.batches import lists
from loomseq.operators.skew import lookup


def scores(rows: DataFrame, seq: str, pos: str, q: str, k: str, dim: int, slope: float) -> DataFrame:
    """(seq, qpos, kpos, score) for the pairs inside a sequence, whose length the encoder bounds."""
    left = rows.select(seq, F.col(pos).alias("qpos"), F.col(q).alias("_q"))
    right = rows.select(seq, F.col(pos).alias("kpos"), F.col(k).alias("_k"))
    raw = dot(F.col("_q"), F.col("_k")) / F.sqrt(F.lit(float(dim)))
    return left.join(right, seq).select(seq, "qpos", "kpos", (raw + alibi_bias(F.lit(slope), F.col("qpos"), F.col("kpos"))).alias("score"))


def weights(scored: DataFrame, seq: str) -> DataFrame:
    """Softmax over the keys of a query."""
    per_query = Window.partitionBy(seq, "qpos")
    e = F.exp(F.col("score") - F.col("_top"))
    return (
        scored.withColumn("_top", F.max("score").over(per_query)).withColumn("_e", e)
        .select(seq, "qpos", "kpos", (F.col("_e") / F.sum("_e").over(per_query)).alias("weight"))
    )


def weighted_values(weighted: DataFrame, rows: DataFrame, seq: str, pos: str, v: str) -> DataFrame:
    """(seq, qpos, dim, value): the weighted sum of the values, one row per dimension."""
    values = rows.select(seq, F.col(pos).alias("kpos"), F.posexplode(v).alias("dim", "_v"))
    return (
        weighted.join(values, [seq, "kpos"]).groupBy(seq, "qpos", "dim")
        .agg(F.sum(F.col("weight") * F.col("_v")).alias("value"))
    )


#: Rows of a block of keys; a sequence of any length is cut into blocks of so many.
BLOCK = 64


def vector_sum(rows: DataFrame, by: list[str], vector: str, dim: int, weight: Column | None = None) -> DataFrame:
    """(by..., vector): sums of vectors of dim components, as one aggregate for each; what a task has of a key is
    added up before the shuffle, and no row is made for a component."""
    part = lambda i: F.get(vector, F.lit(i)) if weight is None else weight * F.get(vector, F.lit(i))
    sums = rows.groupBy(*by).agg(*[F.sum(part(i)).alias(f"_{i}") for i in range(dim)])
    return sums.select(*by, F.array(*[f"_{i}" for i in range(dim)]).alias(vector))


def attend(rows: DataFrame, seq: str, pos: str, q: str, k: str, v: str, dim: int, slope: float, block: int = BLOCK) -> DataFrame:
    """(seq, qpos, value): softmax attention of every query over its whole sequence, as vectors (JOIN6, WIN3, AGG11).

    Keys and values meet a query in blocks. A block gives a state: the largest score m, the sum s of exp(score - m),
    and the sum a of exp(score - m) times the values. Two states merge by scaling to the larger m, so a query's states
    are folded to one; a row is made for a query and block, none for a pair or a component. All blocks of a query
    meet in one row: one state for each `block` keys of its sequence."""
    own = rows.select(seq, F.col(pos).alias("pos"), F.col(q).alias("q"), F.struct(F.col(pos).alias("pos"), F.col(k).alias("k"), F.col(v).alias("v")).alias("kv"))
    blocks = own.groupBy(seq, F.floor(F.col("pos") / block).alias("block")).agg(F.array_sort(F.collect_list("kv")).alias("kvs"))
    met = own.select(seq, F.col("pos").alias("qpos"), "q").join(blocks, seq)
    score = lambda x: dot(F.col("q"), x["k"]) / F.sqrt(F.lit(float(dim))) + alibi_bias(F.lit(slope), F.col("qpos"), x["pos"])
    scored = met.withColumn("scores", F.transform("kvs", score)).withColumn("m", F.array_max("scores"))
    zero = F.array_repeat(F.lit(0.0), F.size(F.get("kvs", F.lit(0))["v"]))
    weighed = scored.withColumn("e", F.transform("scores", lambda x: F.exp(x - F.col("m"))))
    pairs = F.zip_with("e", "kvs", lambda e, x: F.struct(e.alias("e"), x["v"].alias("v")))
    summed = F.aggregate(pairs, zero, lambda a, x: F.zip_with(a, x["v"], lambda s, y: s + x["e"] * y))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    states = weighed.select(seq, "qpos", F.struct("block", "m", total.alias("s"), summed.alias("a")).alias("state"))
    ordered = states.groupBy(seq, "qpos").agg(F.array_sort(F.collect_list("state")).alias("states"))

    def merge(x, y):
        top = F.greatest(x["m"], y["m"])
        left, right = F.exp(x["m"] - top), F.exp(y["m"] - top)
        return F.struct(x["block"].alias("block"), top.alias("m"), (x["s"] * left + y["s"] * right).alias("s"), F.zip_with(x["a"], y["a"], lambda a, b: a * left + b * right).alias("a"))

    rest = F.slice("states", F.lit(2), F.size("states"))
    last = F.aggregate(rest, F.get("states", F.lit(0)), merge)
    return ordered.select(seq, "qpos", last.alias("z")).select(seq, "qpos", F.transform("z.a", lambda a: a / F.col("z.s")).alias("value"))


def fuse_vectors(tokens: DataFrame, incidence: DataFrame, ngrams: DataFrame, dim: int, key: str = "doc_id", vector: str = "v") -> DataFrame:
    """hidden[pos] += sum of the vectors of the n-grams that cover it, whole vectors at a time (JOIN5).

    tokens (key, pos, vector), incidence (key, rk, pos), ngrams (key, rk, vector)."""
    extra = vector_sum(incidence.join(ngrams.withColumnRenamed(vector, "_g"), [key, "rk"]), [key, "pos"], "_g", dim)
    both = tokens.join(extra, [key, "pos"], "left")
    return both.withColumn(vector, F.when(F.col("_g").isNull(), F.col(vector)).otherwise(add(F.col(vector), F.col("_g")))).drop("_g")


def fuse_positions(ngrams: DataFrame, dim: int, key: str = "doc_id", positions: str = "positions", vector: str = "v") -> DataFrame:
    """(key, pos, vector): fuse_vectors() on hidden vectors of zeros, for the positions that an n-gram covers. Each row of
    ngrams has its positions and its vector, so they don't have to meet; what a task has of a position is summed there."""
    return vector_sum(ngrams.select(key, F.explode(positions).alias("pos"), vector), [key, "pos"], vector, dim)


#: Pairs of a position and an n-gram whose vectors are held at a time.
PAIRS = 1 << 14


def table_of(vectors: DataFrame, id_col: str, vector: str, dim: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, their vectors, and how many components of each aren't null (null ones are 0), for fused(). Vectors that
    share an id are summed by Spark; the driver reads `bound` rows at most."""
    rows = vector_sum(vectors.where(F.col(id_col).isNotNull()), [id_col], vector, dim).orderBy(id_col).limit(bound + 1).toArrow()
    if rows.num_rows > bound:
        raise ValueError("the table has more vectors than its bound")
    flat = pa.concat_arrays([pa.array([], pa.float64()), *(c.flatten() for c in rows.column(vector).chunks)])
    filled = np.asarray(pc.is_valid(flat).cast(pa.int8())).reshape(-1, dim).sum(1)
    return np.asarray(rows.column(id_col)).astype(np.int64), np.asarray(pc.fill_null(flat, 0.0)).reshape(-1, dim), filled


def fused(table, named, sums: dict[str, np.ndarray], key: str = "doc_id"):
    """fuse_positions() as a step (batches.py) on (key, ngrams), one row for each key, so that neither n-grams nor vectors are
    shuffled: (key, pos, a column for each of sums), the product of a position's whole fused vector with sums' weights.

    table: a broadcast of table_of(); named(ids) gives the ids in it. Whole vectors are held for PAIRS pairs at a time.
    N-grams without a vector don't count; a position whose vectors have null components alone gets null."""

    def run(b):
        ids, vectors, filled = table.value
        grams, ends = lists(b.column("ngrams"))
        pos, spans = lists(grams.field("pos"))
        wanted = named(np.asarray(grams.field("id")).astype(np.int64))
        at = np.minimum(np.searchsorted(ids, wanted), max(len(ids) - 1, 0))
        known = ids[at] == wanted if len(ids) else np.zeros(len(wanted), bool)
        gram = np.repeat(np.arange(len(wanted)), np.diff(spans))
        row = np.repeat(np.arange(b.num_rows), np.diff(ends))[gram]
        keep = np.nonzero(known[gram])[0]
        order = keep[np.lexsort((np.asarray(pos)[keep], row[keep]))]
        row, place, at = row[order], np.asarray(pos)[order], at[gram[order]]
        heads = np.nonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))[0]
        weights = np.stack(list(sums.values()), 1)
        out, none = np.empty((len(heads), len(sums))), np.zeros(len(heads), bool)
        # Whole positions, about PAIRS pairs at a time.
        cuts = np.unique(np.concatenate([np.searchsorted(heads, np.arange(0, len(at), PAIRS)), [len(heads)]])) if len(heads) else [0]
        for first, last in zip(cuts[:-1], cuts[1:]):
            begin, end = heads[first], heads[last] if last < len(heads) else len(at)
            out[first:last] = np.add.reduceat(vectors[at[begin:end]], heads[first:last] - begin, axis=0) @ weights
            none[first:last] = np.add.reduceat(filled[at[begin:end]], heads[first:last] - begin) == 0
        made = {c: pa.array(x, mask=none) for c, x in zip(sums, out.T)}
        return pa.RecordBatch.from_pydict({key: b.column(key).take(pa.array(row[heads])), "pos": pa.array(place[heads].astype(np.int32))} | made)

    return lambda types: (run, {key: types[key], "pos": "int"} | dict.fromkeys(sums, "double"))


def fuse(tokens: DataFrame, incidence: DataFrame, ngrams: DataFrame, key: str = "doc_id") -> DataFrame:
    """hidden[pos] += sum of the vectors of the n-grams that cover it; positions without one stay.

    tokens (key, pos, dim, value), incidence (key, rk, pos), ngrams (key, rk, dim, value)."""
    extra = (
        incidence.join(ngrams.withColumnRenamed("value", "_g"), [key, "rk"])
        .groupBy(key, "pos", "dim").agg(F.sum("_g").alias("_g"))
    )
    return tokens.join(extra, [key, "pos", "dim"], "left").withColumn("value", F.col("value") + F.coalesce("_g", F.lit(0.0))).drop("_g")


def embed(ids: DataFrame, table: DataFrame, type_vector: Column, id_col: str = "id", vector: str = "vector", table_rows: int | None = None) -> DataFrame:
    """Look up token vectors and add the type vector. The table is broadcast only when its given
    row bound allows it; otherwise ids that hold much of the rows (padding, unknown) are looked up apart from the
    rest, see skew.py, so that none fills a task."""
    small = table_rows is not None and table_rows <= 100_000
    summed = table.withColumn(vector, add(F.col(vector), type_vector))  # once a row of the table, not of ids
    return ids.join(F.broadcast(summed), id_col) if small else lookup(ids, summed, [id_col], "inner")


def cross_entropy(logits: Column, label: Column) -> Column:
    return F.avg(-log_softmax_at(logits, label))


def mse(x: Column, y: Column) -> Column:
    return F.avg((y - x) * (y - x))


def bce_with_logits(x: Column, y: Column) -> Column:
    """Stable form of binary cross-entropy on logits."""
    return F.avg(F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)) - x * y)


def problem_type(num_labels: int, label_type: str) -> str:
    """regression for one label, single label for integer labels, else multi label."""
    if num_labels == 1:
        return "regression"
    return "single_label_classification" if label_type in ("int", "bigint") else "multi_label_classification"
