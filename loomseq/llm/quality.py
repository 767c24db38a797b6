"""Quality by co-training two views.

The text view sees hashed words and word shapes (runs of letters and digits folded to one sign); the
page view sees metadata alone: source, language and both together, and a page's measures (length, lines,
characters a line and a word, shares of distinct lines, digits and signs), but no words. Each view is a
logistic model. Over ROUNDS rounds, each labels the documents of an unlabelled pool of which it is
surest, as many of either kind as the labels' shares ask for and only those SURE above or below the
share in log odds, and hands them to the other. Platt
scaling on rows that neither learned from calibrates each view, and a logistic model on both
calibrated logits scores all documents.

Fits take at most LABELLED labelled and POOL unlabelled rows. Nulls and empty texts have no terms, a
null source or language is a value of its own. Without labels of both kinds every score is their
smoothed share. Rows that repeat a doc_id are scored each; long texts are read whole; an empty table gives
an empty result, and other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm import terms as tm
from loomseq.llm.common import held_out, map_batches, texts_of

MODULUS, REMAINDER = 5, 0
LABELLED, POOL, ROUNDS, GIVE, SURE, FEATURES, META = 20_000, 10_000, 3, 0.05, 1.0, 512, 1024
_SHAPE = [(re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+"), r"\1")]
META_COLUMNS = ["lang", "source", "n_chars"]
#: Where the page view's buckets start in the rows that come to the driver.
META_BASE = tm.BUCKETS


def shape(word: str) -> str:
    for pattern, to in _SHAPE:
        word = pattern.sub(to, word)
    return word


_shapes: dict[str, str] = {}


def text_terms(text: bytes) -> list[int]:
    """Words, and shapes of white-space separated parts."""
    s = text.decode("utf-8", "replace")
    if len(_shapes) > 100_000:
        _shapes.clear()
    found = set()
    for w in set(s.split()):
        k = _shapes.get(w)
        if k is None:
            k = _shapes[w] = "shape:" + shape(w)
        found.add(k)
    return tm._hasher(found | tm.letters(text))


_DIGITS, _BLANK = b"0123456789", b" \t\n\r\x0b\x0c"
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def measures(text: bytes) -> list[str]:
    """A page's measures, each on a coarse scale."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, words = max(1, len(text)), max(1, len(text.split()))
    share = lambda drop: int(np.sqrt((n - len(text.translate(None, drop))) / n) * 20)
    return [
        f"lines:{len(lines).bit_length()}", f"line:{(len(text) // max(1, len(lines))).bit_length()}", f"word:{2 * len(text) // words}",
        f"distinct:{10 * len(set(lines)) // max(1, len(lines))}", f"digits:{share(_DIGITS)}", f"signs:{share(_SIGNS)}",
    ]


def meta_terms(lang, source, n_chars, text: bytes) -> list[int]:
    """Hashed facts of a page in META buckets."""
    size = max(0, n_chars or 0).bit_length()
    facts = [f"l:{lang}", f"s:{source}", f"ls:{lang}:{source}", f"n:{size}", *measures(text)]
    return sorted({xxhash.xxh32_intdigest(f) % META for f in facts})


def logistic(x: tm.Rows, y: np.ndarray, decay: float = 1e-3, steps: int = 300, rate: float = 0.1, least: float = -np.inf) -> np.ndarray:
    """Weights, none below `least`, and, last, the intercept, by Adam on all rows."""
    w, mom, var = (np.zeros(x.width + 1) for _ in range(3))
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    w[-1] = np.log(share / (1 - share))
    keep = np.ones(len(w))
    keep[-1] = 0
    for k in range(1, steps + 1):
        off = tm.sigmoid(logits(x, w)) - y
        g = np.append(x.back(off), off.sum()) / max(1, len(y)) + decay * keep * w
        mom += 0.1 * (g - mom)
        var += 0.001 * (g * g - var)
        w -= rate * mom / (1 - 0.9**k) / (np.sqrt(var / (1 - 0.999**k)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], least)
    return w


class Table:
    """A small dense table with the products of tm.Rows."""

    def __init__(self, x: np.ndarray):
        self.x, self.width = x, x.shape[1]

    def dot(self, w):
        return self.x @ w

    def back(self, g):
        return self.x.T @ g

    def take(self, at):
        return Table(self.x[at])


def logits(x, w: np.ndarray) -> np.ndarray:
    return x.dot(w[:-1]) + w[-1]


@dataclass
class Model:
    chosen: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    platt: np.ndarray  # slope and intercept of each view
    joint: np.ndarray

    def views(self, xt: tm.Rows, xm: tm.Rows) -> np.ndarray:
        z = np.stack([logits(xt, self.text), logits(xm, self.meta)], axis=1)
        return np.clip(z * self.platt[:, 0] + self.platt[:, 1], -8, 8)


def cotrain(xt: tm.Rows, xm: tm.Rows, y: np.ndarray, pool: np.ndarray, rounds: int = ROUNDS, given: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both views after exchanging pseudo-labels. y is -1 for the rows of the pool; what is
    handed over is put into `given` as (view that gave, rows, labels)."""
    has = np.nonzero(y >= 0)[0]
    views, own = (xt, xm), [(has, y[has].astype(float))] * 2
    free = np.zeros(len(y), bool)
    free[pool] = True
    share = y[has].mean() if len(has) else 0.5
    middle = np.log((share + 1e-3) / (1 - share + 1e-3))
    w = [logistic(v.take(i), t) for v, (i, t) in zip(views, own)]
    for _ in range(rounds):
        for k in (0, 1):
            open_ = np.nonzero(free)[0]
            if not len(open_):
                break
            z = logits(views[k].take(open_), w[k])
            order = np.argsort(z, kind="stable")
            many = GIVE * len(pool)
            low, high = order[: int(np.ceil(many * (1 - share)))], order[len(order) - int(np.ceil(many * share)) :]
            low, high = low[z[low] < middle - SURE], high[z[high] > middle + SURE]
            give = np.concatenate([open_[low], open_[high]])
            free[give] = False
            marks = np.concatenate([np.zeros(len(low)), np.ones(len(high))])
            if given is not None:
                given.append((k, give, marks))
            i, t = own[1 - k]
            own[1 - k] = (np.concatenate([i, give]), np.concatenate([t, marks]))
        w = [logistic(v.take(i), t) for v, (i, t) in zip(views, own)]
    return w[0], w[1]


def fit(docs: DataFrame, labels: DataFrame, given: list | None = None) -> Model:
    learn = ~held_out(F.col("doc_id"), MODULUS, REMAINDER)
    known = tm.labels_of(labels, "quality", learn)
    # An id that many rows share is one candidate, and rows without an id are none.
    unlabelled = docs.select("doc_id").where(F.col("doc_id").isNotNull() & learn).distinct()
    picked = tm.sample_ids(known, "y", limit=LABELLED).unionByName(
        tm.sample_ids(unlabelled.join(known.select("doc_id"), "doc_id", "left_anti"), limit=POOL).withColumn("y", F.lit(-1))
    )

    def both(b: pa.RecordBatch, texts: list[bytes]) -> list[list[int]]:
        """The page's buckets come first, the text's after them."""
        facts = zip(*(b.column(c).to_pylist() for c in META_COLUMNS), texts)
        return [sorted(META_BASE + h for h in meta_terms(*m)) + sorted(set(text_terms(t))) for m, t in zip(facts, texts)]

    terms, (y,) = tm.features_of(docs.select("doc_id", "text", *META_COLUMNS), picked, both, ["y"])
    y = np.array(y, dtype=int)
    meta = [t[t >= META_BASE] - META_BASE for t in terms]
    terms = [t[t < META_BASE] for t in terms]
    has = np.nonzero(y >= 0)[0]
    chosen = tm.associated([terms[k] for k in has], y[has].astype(float), FEATURES)
    xt, xm = tm.Rows(terms, chosen), tm.Rows(meta, np.arange(META))
    share = (y[has].sum() + 0.5) / (len(has) + 1.0)
    flat = np.log(share / (1 - share))
    if len(set(y[has])) < 2:
        return Model(chosen, np.zeros(len(chosen) + 1), np.zeros(META + 1), np.array([[0.0, flat]] * 2), np.array([0.0, 0.0, flat]))
    test, train, pool = has[::4], np.array([k for n, k in enumerate(has) if n % 4]), np.nonzero(y < 0)[0]
    if len(set(y[train])) < 2 or len(set(y[test])) < 2:
        train = test = has
    rows = np.concatenate([train, pool])
    wt, wm = cotrain(xt.take(rows), xm.take(rows), y[rows], len(train) + np.arange(len(pool)), given=given)
    x = [xt.take(test), xm.take(test)]
    platt = np.array([logistic(Table(logits(v, w)[:, None]), y[test]) for v, w in zip(x, (wt, wm))])
    m = Model(chosen, wt, wm, platt, np.zeros(3))
    m.joint = logistic(Table(m.views(*x)), y[test], least=0.0)  # a calibrated view never counts against itself
    return m


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, text_score, meta_score, score, keep) for every row."""

    def run(b: pa.RecordBatch):
        texts = texts_of(b)
        xt = tm.Rows([np.array(text_terms(t), np.int64) for t in texts], model.chosen)
        facts = zip(*(b.column(c).to_pylist() for c in META_COLUMNS), texts)
        xm = tm.Rows([np.array(meta_terms(*m), np.int64) for m in facts], np.arange(META))
        z = model.views(xt, xm)
        s = tm.sigmoid(logits(Table(z), model.joint))
        return {"doc_id": b.column("doc_id"), "text_score": tm.sigmoid(z[:, 0]), "meta_score": tm.sigmoid(z[:, 1]), "score": s, "keep": (s >= 0.5).astype(np.int32)}

    got = map_batches(docs.select("doc_id", "text", *META_COLUMNS), run, "doc_id bigint, text_score double, meta_score double, score double, keep int")
    return got.withColumn("held_out", held_out(F.col("doc_id"), MODULUS, REMAINDER)).select("doc_id", "held_out", "text_score", "meta_score", "score", "keep")
