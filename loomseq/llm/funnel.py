"""Ordered funnels: how far each attempt of a client gets through a sequence of steps, by an ordinal equi-join.

A client's rows are numbered within each kind, and every row knows how many rows of each kind the client has
up to its time. So the earliest row of a kind later than a row is the one whose ordinal is that count plus one:
an equi-join on client, kind and ordinal finds it, without a range join and without a client's rows in one place.
The difference of an excluded kind's counts at both rows tells whether such a row lies between them.

Skew: counts come from a two-level scan over ranges of (client, time), so a client with a third of all rows is
spread over as many shards as its rows need. The join's keys hold an ordinal, so they are as fine as the rows.
Attempts that wait for the same next row share a key; where a flood of them does, adaptive execution cuts the
partition of that join, which has the plain form that it can cut. Totals are added up before they are shuffled. A
quantile is found in two levels, by the upper and then by the lower half of a time's bits, so that no task
sees more than about sqrt(within) values of a client's step, however many attempts it has.

Defined results: rows with a null client, kind or time don't count, nor do kinds that no funnel names. Rows of
one client, kind and time count once. Rows of different kinds at the same time don't follow one another, as a
next step must be later; an excluded row at a next step's time stands in its way. A client without a first step has
no row, and an empty table gives none. Other columns are ignored, whatever their names or length. Times may or may
not have a zone; they are compared in microseconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.operators import scan
from loomseq.plans.scratch import fixed

MINUTE = 60_000_000


@dataclass(frozen=True)
class Funnel:
    """Steps in order, the kind that ends an attempt, and the microseconds from the first step to the last."""

    name: str
    steps: tuple[str, ...]
    exclude: str
    within: int = 30 * MINUTE

    def __post_init__(self):
        if len(self.steps) < 2 or self.within < 1:
            raise ValueError("a funnel has two steps or more, and a positive time for them")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970. A time without a zone is read as it stands, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(column)
    t = F.col(column)
    seconds = F.unix_date(F.to_date(t)).cast("bigint") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def counted(clicks: DataFrame, kinds: list[str], client: str, kind: str, at: str) -> DataFrame:
    """(client, t, mask, n): one row for each time of a client, with a bit for each kind that it has then, and the
    client's rows of each kind up to then. Written once."""
    number = F.coalesce(*[F.when(F.col(kind) == k, F.lit(1 << i).cast("bigint")) for i, k in enumerate(kinds)])
    rows = clicks.select(F.col(client).alias("client"), micros(clicks, at).alias("t"), number.alias("bit")).dropna()
    one = rows.groupBy("client", "t").agg(F.bit_or("bit").alias("mask"))
    flags = one.withColumns({f"f{i}": F.shiftright("mask", i).bitwiseAND(F.lit(1)) for i in range(len(kinds))})
    sums = {f"n{i}": f"f{i}" for i in range(len(kinds))}
    return fixed(scan.prefix_sums(flags, ["t"], sums, by=["client"], inclusive=True).select("client", "t", "mask", F.array(*sums).alias("n")))


def _choose(values: list, funnel: Column) -> Column:
    """The funnel's own value of a list with one for each funnel; rows carry the funnel's number alone."""
    return F.get(F.array(*[F.lit(v) for v in values]), funnel)


def first_steps(table: DataFrame, funnels: list[Funnel], kinds: list[str]) -> DataFrame:
    """table with a row for each funnel that begins with a kind of the row: its number as funnel."""
    begins = [F.when(_has(F.lit(kinds.index(f.steps[0]))), F.lit(i)) for i, f in enumerate(funnels)]
    return table.withColumn("funnel", F.explode(F.array_compact(F.array(*begins))))


def _has(k: Column) -> Column:
    return F.call_function("getbit", F.col("mask"), k) == 1


def reached(table: DataFrame, funnels: list[Funnel], kinds: list[str]) -> DataFrame:
    """(funnel, client, d): one row for each attempt that reached its second step; d has the microseconds from the
    previous step to each later one, null from where the attempt ends."""
    width, f = max(len(f.steps) for f in funnels), F.col("funnel")
    step = lambda i: _choose([kinds.index(x.steps[i]) if i < len(x.steps) else None for x in funnels], f)
    excluded, within = _choose([kinds.index(x.exclude) for x in funnels], f), _choose([x.within for x in funnels], f)
    later = sorted({kinds.index(s) for x in funnels for s in x.steps[1:]})
    targets = table.select("client", "t", "n", F.explode(F.filter(F.array(*[F.lit(k) for k in later]), _has)).alias("kind")).select(
        "client", "kind", F.get("n", F.col("kind")).alias("ordinal"), F.col("t").alias("t_next"), F.col("n").alias("n_next")
    )
    now = first_steps(table, funnels, kinds).select(
        "client", "funnel", F.col("t").alias("t0"), F.col("t"), F.get("n", step(0)).alias("own"), F.get("n", excluded).alias("past"), (F.get("n", step(1)) + 1).alias("next")
    )
    for i in range(1, width):
        # An ended attempt looks for an ordinal of its own that no row has, so that ended ones aren't gathered.
        left = now.withColumns({"kind": F.coalesce(step(i), F.lit(-1)), "ordinal": F.coalesce("next", -F.col("own"))}).drop("next")
        got = (F.col("t_next") - F.col("t0") <= within) & (F.get("n_next", excluded) == F.col("past"))
        met = left.join(targets, ["client", "kind", "ordinal"], "inner" if i == 1 else "left")
        if i == 1:
            met, got = met.where(got), F.lit(True)
        onward = step(i + 1) if i + 1 < width else F.lit(None).cast("int")
        now = met.select(
            "client", "funnel", "t0", "own", "past", *[f"d{j}" for j in range(1, i)], F.when(got, F.col("t_next") - F.col("t")).alias(f"d{i}"),
            F.when(got, F.get("n_next", onward) + 1).alias("next"), F.when(got, F.col("t_next")).alias("t"),
        )
    return now.select("funnel", "client", F.array(*[f"d{i}" for i in range(1, width)]).alias("d"))


def quantile(times: DataFrame, by: list[str], within: int, percent: int) -> DataFrame:
    """(by..., q): of rows (by..., d, n), n values of d from 0 to within, the ceil(percent * all / 100)-th smallest.

    First the upper half of d's bits is settled, then the lower one; a group has at most about sqrt(within)
    different values of either."""
    half = (within.bit_length() + 1) // 2
    group = Window.partitionBy(*by)
    upto = lambda c: group.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    coarse = times.groupBy(*by, F.shiftright("d", half).alias("hi")).agg(F.sum("n").alias("n"))
    rank = coarse.withColumns({"upto": F.sum("n").over(upto("hi")), "all": F.sum("n").over(group)})
    rank = rank.withColumn("k", F.expr(f"({percent} * all + 99) div 100"))
    chosen = rank.where("upto >= k and upto - n < k").select(*by, "hi", (F.col("k") - (F.col("upto") - F.col("n"))).alias("k"))
    fine = times.withColumn("hi", F.shiftright("d", half)).join(chosen, [*by, "hi"]).withColumn("upto", F.sum("n").over(upto("d")))
    return fine.where("upto >= k").groupBy(*by).agg(F.min("d").alias("q"))


def counts(clicks: DataFrame, funnels: list[Funnel], client: str = "client_id", kind: str = "kind", at: str = "arrived_at", percent: int = 90) -> DataFrame:
    """(funnel, client, n1.., deepest, t2.., same_depth) for every funnel and client with an attempt.

    n<i>: attempts that reach step i; deepest: the last step that any reached; t<i>: the given percentile of the
    microseconds from the step before, over the attempts that reached step i, null if none did; same_depth: clients
    of the same funnel and deepest step. Shorter funnels have 0 and null beyond their last step."""
    kinds = sorted({k for f in funnels for k in (*f.steps, f.exclude)})
    width, longest = max(len(f.steps) for f in funnels), max(f.within for f in funnels)
    table = counted(clicks, kinds, client, kind, at)
    steps = F.filter(F.transform("d", lambda d, i: F.struct((i + 2).alias("step"), d.alias("d"))), lambda s: s["d"].isNotNull())
    each = reached(table, funnels, kinds).select("funnel", "client", F.explode(steps).alias("s")).select("funnel", "client", "s.step", "s.d")
    begun = first_steps(table, funnels, kinds).select("funnel", "client", F.lit(1).alias("step"), F.lit(0).cast("bigint").alias("d"))
    times = fixed(each.unionByName(begun).groupBy("funnel", "client", "step", "d").agg(F.count(F.lit(1)).alias("n")))
    totals = times.groupBy("funnel", "client").agg(
        *[F.sum(F.when(F.col("step") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(1, width + 1)], F.max("step").alias("deepest")
    )
    q = quantile(times.where("step > 1"), ["funnel", "client", "step"], longest, percent)
    wide = q.groupBy("funnel", "client").agg(*[F.max(F.when(F.col("step") == i, F.col("q"))).alias(f"t{i}") for i in range(2, width + 1)])
    depths = totals.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))
    name = F.get(F.array(*[F.lit(f.name) for f in funnels]), F.col("funnel"))
    # A row for each funnel and step is broadcast.
    return totals.join(wide, ["funnel", "client"], "left").join(F.broadcast(depths), ["funnel", "deepest"]).select(
        name.alias("funnel"), F.col("client").alias(client), *[f"n{i}" for i in range(1, width + 1)], "deepest", *[f"t{i}" for i in range(2, width + 1)], "same_depth"
    )
