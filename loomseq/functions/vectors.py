"""Vector expressions: argmax, dot, softmax, layer norm, ALiBi, activations (MTH1-MTH10)."""

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: Spark repeats an expression inside a lambda
    for each element, but binds a lambda's argument."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def argmax(v: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def softmax(v: Column) -> Column:
    """Softmax of one row, shifted by its maximum."""
    shifted = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_softmax_at(v: Column, index: Column) -> Column:
    """log softmax(v)[index], without underflow."""
    return let(F.array_max(v), lambda top: F.get(v, index) - top - F.log(total(F.transform(v, lambda x: F.exp(x - top)))))


def layer_norm(v: Column, eps: float = 1e-12) -> Column:
    """(v - mean) / sqrt(variance + eps); the variance divides by n."""
    centred = let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))

    def scaled(c):
        var = total(F.transform(c, lambda x: x * x)) / F.size(c)
        return let(F.sqrt(var + F.lit(eps)), lambda sd: F.transform(c, lambda x: x / sd))

    return let(centred, scaled)


def additive_mask(mask: Column) -> Column:
    """0 where attended, -10000 elsewhere."""
    return (F.lit(1.0) - mask.cast("double")) * F.lit(-10000.0)


def alibi_slopes(heads: int) -> list[float]:
    """Geometric slopes; when heads isn't a power of two, the next power's odd-numbered slopes fill up."""
    whole = 1 << (heads.bit_length() - 1)
    ladder = [2.0 ** (-8.0 * (i + 1) / whole) for i in range(whole)]
    finer = [2.0 ** (-8.0 * (i + 1) / (2 * whole)) for i in range(0, 2 * whole, 2)]
    return ladder + finer[: heads - whole]


def alibi_bias(slope: Column, query: Column, key: Column) -> Column:
    return F.lit(0.0) - slope * F.abs(key - query).cast("double")


def _erf_series(x: np.ndarray) -> np.ndarray:
    """exp(-x^2) times a series of positive terms, for x from 0 to 6."""
    term = total = x
    for n in range(1, 140):
        term = term * (2.0 * x * x / (2 * n + 1))
        total = total + term
    return np.minimum(1.0, 2.0 / math.sqrt(math.pi) * np.exp(-x * x) * total)


#: Places of erf's table for each 1; a place has the polynomial of degree 5 around it, whose rest is below 1e-16.
ERF_PLACES = 256


@functools.cache
def _erf_table() -> list[np.ndarray]:
    """Coefficients of degree 0 to 5 at each place from 0 to 6: derivatives of erf are Hermite polynomials times exp(-x^2)."""
    c = np.arange(6 * ERF_PLACES + 1) / ERF_PLACES
    d = 2.0 / math.sqrt(math.pi) * np.exp(-c * c)
    return [_erf_series(c), d, -c * d, (2 * c * c - 1) * d / 3, (3 - 2 * c * c) * c * d / 6, (4 * c**4 - 12 * c * c + 3) * d / 30]


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of whole arrays, from the polynomial around the nearest place of a table; 1 from 6 on."""
    a = np.minimum(np.abs(x), 6.0)
    nearest = np.rint(a * ERF_PLACES)
    rest, at = a - nearest / ERF_PLACES, np.fmin(nearest, 6.0 * ERF_PLACES).astype(np.intp)  # a place for NaN, too, whose rest is NaN
    *lower, out = (c.take(at) for c in _erf_table())
    for c in reversed(lower):
        out *= rest
        out += c
    return np.copysign(np.minimum(1.0, out, out=out), x)


@F.pandas_udf(T.DoubleType())
def gelu(x: pd.Series) -> pd.Series:
    """Exact GELU. Spark SQL has no erf, hence Arrow batches."""
    return 0.5 * x * (1.0 + erf(x.to_numpy(dtype=float) / math.sqrt(2.0)))


#: Activations by name, as a configuration names them.
ACTIVATIONS = {
    "gelu": gelu,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "tanh": F.tanh,
    "silu": lambda x: x / (F.lit(1.0) + F.exp(-x)),
}
