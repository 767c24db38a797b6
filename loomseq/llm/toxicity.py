"""Toxicity by a factorization machine over hashed terms.

A document's features are the hashed, lower-cased runs of letters that it contains. The score is
sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>), so that two terms together can weigh more, or
less, than both alone. Pairs are summed by (|sum v|^2 - sum |v|^2) / 2.

The fit learns from labelled rows that aren't held out, at most SAMPLE of them, over the up to
FEATURES buckets most associated with the label, and those of pairs that tell something together, be
their parts neutral or not (terms.interacting). How much a pair must tell is picked among BARS, which follow from
the number of pairs alone, on a fifth of the rows to learn from; held-out rows decide nothing. Nulls and empty texts get the score without any term, long
texts are read whole. Without labelled rows of both kinds the score is the smoothed share of toxic ones.
Rows that repeat a doc_id count once in the fit, by the least digest of their texts, and are scored each. Labels, lang, source and doc_id are no inputs of
a score. Extra columns are ignored by scores() and kept by keep_clean().
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm import terms as tm
from loomseq.llm.common import held_out, map_batches, texts_of

MODULUS, REMAINDER = 5, 0
FEATURES, FACTORS, EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 1024, 8, 30, 1000, 256, 0.02, 1e-5, 3
ROWS_A_TERM = 16
AMONG, FOLDS = 2048, 5
#: How many of all pairs among AMONG terms may pass a bar by chance; without pairs (the last bar) none does.
CHANCE = (1.0, 1e-2, 1e-4)


def bars(chance: tuple[float, ...] = CHANCE, among: int = AMONG) -> tuple[float, ...]:
    """Quantiles of chi-squared with one degree of freedom that this many pairs exceed by chance: the square
    of a normal quantile. No row decides them."""
    pairs = among * (among - 1) / 2
    return (*(NormalDist().inv_cdf(c / pairs / 2) ** 2 for c in chance), float("inf"))


BARS = bars()


@dataclass
class Machine:
    """w0 (1,), w (n,), v (n, k) over the chosen buckets."""

    chosen: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.w0 + x @ self.w + 0.5 * ((s * s).sum(1) - x @ (self.v * self.v).sum(1))

    def scorer(self):
        """Text bytes to score, term by term."""
        place = {int(b): k for k, b in enumerate(self.chosen)}

        def score(text: bytes) -> float:
            at = sorted({place[b] for b in tm.term_set(text) if b in place})
            s = self.v[at].sum(0)
            z = self.w0 + self.w[at].sum() + 0.5 * ((s * s).sum() - (self.v[at] ** 2).sum())
            return float(tm.sigmoid(z))

        return score


def train(terms: list[np.ndarray], y: np.ndarray, features: int = FEATURES, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """The machine over the terms at the bar that does best on every FOLDSth row when it learns from the
    other ones; it then learns from all. Ties go to the higher bar, which takes fewer terms."""
    test = np.arange(len(y)) % FOLDS == FOLDS - 1
    rest = [terms[k] for k in np.flatnonzero(~test)]
    loss, known = [], {}
    for chosen in selections(rest, y[~test], features):
        if chosen.tobytes() not in known:
            m = descend(rest, y[~test], chosen, factors, epochs)
            z = m.logits(tm.Rows([terms[k] for k in np.flatnonzero(test)], chosen).dense()) if test.any() else np.zeros(0)
            known[chosen.tobytes()] = float(np.logaddexp(0, np.where(y[test] > 0, -z, z)).sum())
        loss.append(known[chosen.tobytes()])
    bar = max(k for k, x in enumerate(loss) if x == min(loss))
    return descend(terms, y, selections(terms, y, features)[bar], factors, epochs)


def selections(terms: list[np.ndarray], y: np.ndarray, features: int) -> list[np.ndarray]:
    """For each of BARS the buckets to learn: single terms and those of pairs. A term needs ROWS_A_TERM
    rows to be learned from, so that few rows don't fit chance."""
    single = tm.associated(terms, y, min(features, max(32, len(y) // ROWS_A_TERM)))
    return [np.union1d(single, pairs) for pairs in tm.interacting(terms, y, BARS, AMONG)]


def descend(terms: list[np.ndarray], y: np.ndarray, chosen: np.ndarray, factors: int, epochs: int) -> Machine:
    """Adam on the logistic loss with weight decay, over the given epochs or STEPS batches if that is
    more; the order of rows is drawn from SEED."""
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.01
    r = np.random.default_rng(SEED)
    m = Machine(chosen, float(np.log(share / (1 - share))), np.zeros(len(chosen)), r.normal(0, 0.05, (len(chosen), factors)))
    if not len(chosen):
        return m
    x = tm.Rows(terms, chosen)
    p = [np.array([m.w0]), m.w, m.v]
    mom, var, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(max(epochs, -(-STEPS // (1 + len(y) // BATCH)))):
        order = r.permutation(len(y))
        for c in range(0, len(y), BATCH):
            at = order[c : c + BATCH]
            b = x.take(at).dense().astype(np.float64)
            m.w0 = float(p[0][0])
            g = (tm.sigmoid(m.logits(b)) - y[at]) / len(at)
            inner = b.T @ (g[:, None] * (b @ m.v)) - (b.T @ g)[:, None] * m.v
            step += 1
            for k, grad in enumerate((np.array([g.sum()]), b.T @ g + DECAY * m.w, inner + 10 * DECAY * m.v)):
                mom[k] += 0.1 * (grad - mom[k])
                var[k] += 0.001 * (grad * grad - var[k])
                p[k] -= RATE * (mom[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    m.w0 = float(p[0][0])
    return m


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    learn = ~held_out(F.col("doc_id"), MODULUS, REMAINDER)
    picked = tm.sample_ids(tm.labels_of(labels, "toxic", learn), "y")
    terms, (y,) = tm.features_of(docs.select("doc_id", "text"), picked, lambda b, texts: [sorted(set(tm.term_set(t))) for t in texts], ["y"])
    return train(terms, np.array(y, dtype=np.float64))


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    made = []

    def run(b: pa.RecordBatch):
        if not made:
            made.append(machine.scorer())
        known: dict[bytes, float] = {}
        out = []
        for t in texts_of(b):
            if t not in known:
                known[t] = made[0](t)
            out.append(known[t])
        return {"doc_id": b.column("doc_id"), "score": out, "predicted": [int(s >= 0.5) for s in out]}

    got = map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, score double, predicted int")
    return got.withColumn("held_out", held_out(F.col("doc_id"), MODULUS, REMAINDER)).select("doc_id", "held_out", "score", "predicted")


def keep_clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows whose score is below one half, with all their columns."""
    made = []

    def run(b: pa.RecordBatch):
        if not made:
            made.append(machine.scorer())
        return b.filter(pa.array([made[0](t) < 0.5 for t in texts_of(b)]))

    return map_batches(docs, run, docs.schema)
