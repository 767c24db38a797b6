"""Classification metrics from a confusion table (AGG3-AGG8, MET1-MET2, FLT7).

One aggregation over the rows gives the confusion counts; everything else works on classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomseq.functions.vectors import argmax

IGNORE = -100


def flatten_logits(df: DataFrame, logits: str, labels: str) -> DataFrame:
    """Rows with a matrix of logits and a list of labels become one row per position (MTH2)."""
    both = F.arrays_zip(F.col(logits).alias("_l"), F.col(labels).alias("_y"))
    return df.select(F.explode(both).alias("_z")).select(F.col("_z._l").alias(logits), F.col("_z._y").alias(labels))


def predictions(df: DataFrame, logits: str, label: str, keep: list[str] | None = None) -> DataFrame:
    """(keep..., label, pred) without ignored labels."""
    cols = [F.col(c) for c in keep or []]
    return df.where(F.col(label) != IGNORE).select(*cols, F.col(label).cast("int").alias("label"), argmax(F.col(logits)).alias("pred"))


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def scores(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy, macro f1, precision and recall, and the Matthews correlation of a confusion table.

    Classes are the union of true and predicted ones; a score without a denominator is 0."""
    by = by or []
    side = lambda cls, t, p: table.select(
        *by, F.col(cls).alias("cls"), (F.col("n") * t).alias("t"), (F.col("n") * p).alias("p"),
        F.when((F.col("label") == F.col("pred")) & F.lit(bool(t)), F.col("n")).otherwise(F.lit(0)).alias("tp"),
    )
    classes = (
        side("label", 1, 0).unionByName(side("pred", 0, 1))
        .groupBy(*by, "cls").agg(*[F.sum(c).cast("double").alias(c) for c in ("t", "p", "tp")])
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s, c = F.sum("t"), F.sum("tp")
    cross, tt, pp = F.sum(F.col("t") * F.col("p")), F.sum(F.col("t") * F.col("t")), F.sum(F.col("p") * F.col("p"))
    return classes.groupBy(*by).agg(
        F.coalesce(F.try_divide(c, s), F.lit(0.0)).alias("accuracy"),
        F.avg(share(2 * F.col("tp"), F.col("t") + F.col("p"))).alias("f1"),
        F.coalesce(F.try_divide(c * s - cross, F.sqrt((s * s - pp) * (s * s - tt))), F.lit(0.0)).alias("matthews_correlation"),
        F.avg(share(F.col("tp"), F.col("p"))).alias("precision"),
        F.avg(share(F.col("tp"), F.col("t"))).alias("recall"),
    )


def history(evaluations: DataFrame, key: str = "epoch_key", order: str = "step") -> DataFrame:
    """Last write wins: one row per key, the one with the highest order."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return evaluations.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", order)


def label_stats(df: DataFrame, label: str) -> DataFrame:
    """Row count and number of distinct labels."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(label).alias("num_labels"))


class Watched:
    """Metrics of a frame in the same pass that writes it: no second scan, no confusion table (evaluation hook).

    `classes` is the number of classes, which the model fixes; labels and predictions are 0 to classes - 1. Use
    the frame that rows() gives in place of the old one; once an action has run over it, result() has the metrics."""

    def __init__(self, classes: int, name: str | None = None):
        self.classes, self.seen = classes, Observation(name) if name else Observation()

    def rows(self, df: DataFrame, label: str, pred: str) -> DataFrame:
        counted = F.col(label) != IGNORE
        at = lambda c, k: F.coalesce(F.sum((counted & (F.col(c) == k)).cast("bigint")), F.lit(0))
        both = lambda k: F.coalesce(F.sum((counted & (F.col(label) == k) & (F.col(pred) == k)).cast("bigint")), F.lit(0))
        facts = [x for k in range(self.classes) for x in (at(label, k).alias(f"t{k}"), at(pred, k).alias(f"p{k}"), both(k).alias(f"tp{k}"))]
        return df.observe(self.seen, *facts)

    def result(self) -> dict[str, float]:
        """accuracy, f1, matthews_correlation, precision and recall, as scores() gives them."""
        x = self.seen.get
        t, p, tp = ([x[f"{n}{k}"] for k in range(self.classes)] for n in ("t", "p", "tp"))
        met = [k for k in range(self.classes) if t[k] or p[k]]
        s, c, share = sum(t), sum(tp), lambda a, b: a / b if b else 0.0
        mean = lambda f: share(sum(map(f, met)), len(met))
        spread = ((s * s - sum(v * v for v in p)) * (s * s - sum(v * v for v in t))) ** 0.5
        return {
            "accuracy": share(c, s), "f1": mean(lambda k: share(2 * tp[k], t[k] + p[k])), "matthews_correlation": share(c * s - sum(a * b for a, b in zip(t, p)), spread),
            "precision": mean(lambda k: share(tp[k], p[k])), "recall": mean(lambda k: share(tp[k], t[k])),
        }
