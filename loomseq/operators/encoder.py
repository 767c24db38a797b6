"""Forward pass of encoder blocks (section 2.13 of the survey), one sequence at a time.

Linear layers need matrix products, so each sequence's rows, at most the maximum sequence length,
meet: in one pandas group (encode), or in one record of arrays (operators.model), without a shuffle.
Weights are plain numpy arrays that the caller supplies; a bias or a norm's gain and offset that is left
out counts as none."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomseq.functions.vectors import alibi_slopes, erf


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))


def norm(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray] | None = None, eps: float = 1e-12) -> np.ndarray:
    """Layer norm; scale is (gain, offset)."""
    n = x.shape[-1]
    x = x - (x @ np.full(n, 1.0 / n))[..., None]  # a product is faster than sums along short rows
    x /= np.sqrt(np.einsum("...i,...i->...", x, x) / n + eps)[..., None]
    if scale is not None:
        x *= scale[0]
        x += scale[1]
    return x


def linear(x: np.ndarray, weight: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    return x @ weight if bias is None else x @ weight + bias


#: Queries whose scores are held at a time.
QUERIES = 64
#: Scores up to this many need no shift by their maximum: their exponentials and sums of these are far from the ends of doubles.
UNSHIFTED = 300.0


@functools.lru_cache(4)
def _decays(heads: int, size: int) -> np.ndarray:
    """(heads, 2 size - 1): exp of the distance bias, for distances from size - 1 over 0 to size - 1."""
    return np.exp(-np.array(alibi_slopes(heads))[:, None] * np.abs(np.arange(1 - size, size)))


def attend(queries: np.ndarray | slice, qkv: np.ndarray, heads: int, mask: np.ndarray, distance: bool, kinds: np.ndarray | None = None) -> np.ndarray:
    """Attention of the chosen rows to all rows, a block of queries at a time. Where mask isn't 1, -10000 is added to a key's
    scores, and with distance each head's slope times the distance is taken off. queries: their places; a slice stands for all.

    kinds numbers the rows from 0 on: rows of a kind are alike. Scores are then made once for each pair of kinds."""
    n, d = len(qkv), qkv.shape[1] // 3
    size = d // heads
    whole = isinstance(queries, slice)
    out = np.empty((n if whole else len(queries), d))
    shown = None if kinds is None else np.zeros(kinds.max() + 1, np.intp)
    if kinds is not None:
        shown[kinds] = np.arange(n)
    decays = np.lib.stride_tricks.sliding_window_view(_decays(heads, room := 1 << max(n - 1, 1).bit_length()), n, axis=1) if distance else None
    slopes = alibi_slopes(heads)
    for h in range(heads):
        q, k, v = (qkv[:, part * d + h * size : part * d + (h + 1) * size] for part in range(3))
        q = q / math.sqrt(size)
        weighed = np.concatenate([v, np.ones((n, 1))], 1)
        plain = (mask == 1).all() and (q * q).sum(1).max() * (k * k).sum(1).max() <= UNSHIFTED**2
        pairs = None
        if plain and kinds is not None:
            pairs = q[shown] @ k[shown].T
            np.exp(pairs, out=pairs)
        for c in range(0, len(out), QUERIES):
            at = slice(c, min(c + QUERIES, n)) if whole else queries[c : c + QUERIES]
            s = q[at] @ k.T if pairs is None else pairs.take(kinds[at], 0).take(kinds, 1)
            if plain:
                if pairs is None:
                    np.exp(s, out=s)
                if distance:
                    s *= decays[h][room - at.stop : room - at.start][::-1] if whole else decays[h][room - 1 - at]
            else:
                if distance:
                    s -= slopes[h] * np.abs(np.arange(n)[at][:, None] - np.arange(n))
                s += (1.0 - mask) * -10000.0
                s -= s.max(1, keepdims=True)
                np.exp(s, out=s)
            made = s @ weighed
            out[c : c + len(s), h * size : (h + 1) * size] = made[:, :-1] / made[:, -1:]
    return out


@dataclass
class BlockWeights:
    """wqkv (d, 3d), wo (d, d), gated (d, 2m), down (m, d), with the biases and norms that the layers have."""

    wqkv: np.ndarray
    wo: np.ndarray
    gated: np.ndarray
    down: np.ndarray
    heads: int
    bqkv: np.ndarray | None = None
    bo: np.ndarray | None = None
    bdown: np.ndarray | None = None
    norm1: tuple[np.ndarray, np.ndarray] | None = None
    norm2: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def fixed(cls, dim: int, inner: int, heads: int, seed: int) -> BlockWeights:
        """Small repeatable weights for tests and demonstrations."""
        r = np.random.default_rng(seed)
        make = lambda *s: r.normal(0.0, 0.02, s)
        return cls(make(dim, 3 * dim), make(dim, dim), make(dim, 2 * inner), make(inner, dim), heads)


@dataclass
class PlainWeights:
    """A block without distance bias and gate, as n-grams pass through; up is (d, m)."""

    wqkv: np.ndarray
    wo: np.ndarray
    up: np.ndarray
    down: np.ndarray
    heads: int
    bqkv: np.ndarray | None = None
    bo: np.ndarray | None = None
    bup: np.ndarray | None = None
    bdown: np.ndarray | None = None
    norm1: tuple[np.ndarray, np.ndarray] | None = None
    norm2: tuple[np.ndarray, np.ndarray] | None = None


def block(x: np.ndarray, mask: np.ndarray, w: BlockWeights, subset: np.ndarray | None = None, kinds: np.ndarray | None = None) -> np.ndarray:
    """Attention with linear distance bias, then the gated feed-forward; both with residual norm. With a
    subset, only these rows are made, though they attend to all. kinds: see attend()."""
    rows = slice(None) if subset is None else np.asarray(subset)
    mixed = attend(rows, linear(x, w.wqkv, w.bqkv), w.heads, mask, True, kinds)
    x = norm(linear(mixed, w.wo, w.bo) + x[rows], w.norm1)
    gate, value = np.split(x @ w.gated, 2, axis=1)
    return norm(linear(gelu(gate) * value, w.down, w.bdown) + x, w.norm2)


def plain_block(x: np.ndarray, mask: np.ndarray, w: PlainWeights) -> np.ndarray:
    mixed = attend(slice(None), linear(x, w.wqkv, w.bqkv), w.heads, mask, False)
    x = norm(linear(mixed, w.wo, w.bo) + x, w.norm1)
    return norm(linear(gelu(linear(x, w.up, w.bup)), w.down, w.bdown) + x, w.norm2)


def forward(x: np.ndarray, mask: np.ndarray, layers: list[BlockWeights], grams: np.ndarray | None = None, gram_mask: np.ndarray | None = None, incidence: np.ndarray | None = None, gram_layers: list[PlainWeights] = (), subset: np.ndarray | None = None, kinds: np.ndarray | None = None) -> np.ndarray:
    """All layers over one sequence; after each of the first len(gram_layers) the n-grams pass through
    theirs, and what covers a position is added to it (incidence: positions by n-grams, of which the
    first rows count, one for each row that is attended to). Rows that aren't attended to come back as 0.
    With a subset of positions, the last layer makes these alone and adds nothing. kinds, one for each row that is attended
    to: which rows of x are alike, see attend(); the first layer uses it."""
    live = np.nonzero(mask == 1)[0]
    packed, out = x[live], np.zeros_like(x, dtype=float)
    if not len(live):
        return out if subset is None else out[subset]
    ones = np.ones(len(live))
    for k, w in enumerate(layers):
        last = subset is not None and k == len(layers) - 1
        packed = block(packed, ones, w, np.searchsorted(live, subset) if last else None, None if k else kinds)
        if last:
            return packed
        if k < len(gram_layers):
            grams = plain_block(grams, gram_mask, gram_layers[k])
            packed = packed + (incidence @ grams)[: len(packed)]
    out[live] = packed
    return out


def encode(rows: DataFrame, seq: str, pos: str, vector: str, layers: list[BlockWeights], mask: str | None = None) -> DataFrame:
    """(seq, pos, vector) after all layers; masked rows come back as they were."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        live = np.ones(len(pdf)) if mask is None else pdf[mask].to_numpy(dtype=float)
        keep = live == 1
        packed = x[keep]
        for w in layers:
            if len(packed):
                packed = block(packed, np.ones(len(packed)), w)
        x[keep] = packed
        return pd.DataFrame({seq: pdf[seq], pos: pdf[pos], vector: list(x)})

    types = dict(rows.dtypes)
    cols = [seq, pos, vector] + ([mask] if mask else [])
    return rows.select(*cols).groupBy(seq).applyInPandas(run, f"{seq} {types[seq]}, {pos} {types[pos]}, {vector} array<double>")


def pool(first: DataFrame, vector: str, weight: np.ndarray) -> DataFrame:
    """tanh(first @ weight) for rows at position 0, in Arrow batches."""
    schema = first.schema

    def run(batches):
        for pdf in batches:
            if len(pdf):
                pdf[vector] = list(np.tanh(np.stack(pdf[vector].to_numpy()) @ weight))
            yield pdf

    return first.mapInPandas(run, schema)
