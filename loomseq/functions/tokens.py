"""Functions on token arrays: truncate, add specials, pad, mask, dense matrices (ARR1-ARR12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(tokens: Column, max_seq_length: int) -> Column:
    """Keep what fits beside two special tokens."""
    if max_seq_length < 2:
        raise ValueError("max_seq_length must leave room for two special tokens")
    return F.slice(tokens, 1, max_seq_length - 2)


def add_specials(tokens: Column, cls: str, sep: str) -> Column:
    return F.concat(F.array(F.lit(cls)), tokens, F.array(F.lit(sep)))


def pad_right(values: Column, length: int, pad) -> Column:
    """Pad to length; longer arrays stay as they are."""
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(values))))


def mask_of(values: Column, pad) -> Column:
    """1 where the value differs from the pad value, else 0."""
    return F.transform(values, lambda v: (v != F.lit(pad)).cast("int"))


def dense_row(positions: Column, length: Column | int) -> Column:
    """0/1 row of the given length with ones at the 0-based positions."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.array_contains(positions, p.cast("int")).cast("int"))


def transpose(matrix: Column, length: int) -> Column:
    """Rows become columns; length is the size of a row. A matrix without rows gives empty rows."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)), lambda p: F.transform(matrix, lambda row: F.get(row, p))
    )


def stable_partition(values: Column, is_pad) -> Column:
    """Elements that aren't padding first, each part in its old order."""
    return F.concat(F.filter(values, lambda v: ~is_pad(v)), F.filter(values, is_pad))


def append_dummy(ids: Column, mask: Column, pad_id: int) -> tuple[Column, Column]:
    """A trailing pad token that attention ignores, as generation needs it (ARR12)."""
    return F.concat(ids, F.array(F.lit(pad_id))), F.concat(mask, F.array(F.lit(0)))
