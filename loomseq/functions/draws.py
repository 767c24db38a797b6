"""Deterministic uniform draws (MTH3): a function of seed, row, position and salt alone, so that
results do not depend on partitioning, retries or the engine."""

from __future__ import annotations

import functools
import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: int, row: Column, pos: Column, salt: str) -> Column:
    """32 bits of an md5 digest as eight digits."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), pos.cast("string"), F.lit(salt))), 1, 8)


def below(seed: int, row: Column, pos: Column, salt: str, rate: float) -> Column:
    """uniform() < rate, by comparing digits: no number is made."""
    bar = math.ceil(rate * 2**32)
    return F.lit(True) if bar >= 2**32 else _digest(seed, row, pos, salt) < f"{max(bar, 0):08x}"


def uniform(seed: int, row: Column, pos: Column, salt: str) -> Column:
    """A double in [0, 1) from the first 32 bits of an md5 digest."""
    return F.conv(_digest(seed, row, pos, salt), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_int(seed: int, row: Column, pos: Column, salt: str, below: int) -> Column:
    """An integer in [0, below)."""
    return F.floor(uniform(seed, row, pos, salt) * below).cast("int")


class RowDraws:
    """The draws of one row where tasks work on Arrow batches: the same digests, so the same results, as below(), uniform() and
    uniform_int() give. row is the row's key as a string; a null one is left out, as concat_ws() leaves it out."""

    def __init__(self, seed: int, row: str | None):
        self.head = (f"{seed}:" if row is None else f"{seed}:{row}:").encode()

    def below(self, places, salt: str, rate: float) -> list[int]:
        """Those of the places whose draw is below rate."""
        bar = math.ceil(rate * 2**32)
        if bar >= 2**32:
            return list(places)
        # A digest stands before four bytes if its own first four do.
        head, least, md5 = self.head, max(bar, 0).to_bytes(4), hashlib.md5
        return [i for i in places if md5(head + _tail(i, salt)).digest() < least]

    def uniform(self, place: int, salt: str) -> float:
        return int.from_bytes(hashlib.md5(self.head + _tail(place, salt)).digest()[:4]) / 4294967296.0

    def uniform_int(self, place: int, salt: str, below: int) -> int:
        return math.floor(self.uniform(place, salt) * below)


@functools.lru_cache(1 << 14)
def _tail(place: int, salt: str) -> bytes:
    return f"{place}:{salt}".encode()
