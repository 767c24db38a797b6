"""A Bloom filter built by aggregation: what surely has no partner goes before a join shuffles it.

The filter is a table of 64-bit words. A key's hash names a word and BITS bits of it; words are made by an OR over
the keys, partial before the shuffle. The table is sent once, as a broadcast whose size is bounded by the number
of words, and a row asks one word. About one row in a hundred without a partner passes; none with one is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, KEYS_A_WORD = 4, 5
#: Words of a filter that may be broadcast: 16 bytes each and the hash table around them, about 100 MB.
MAX_WORDS = 2_000_000


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("word")), F.lit(words))


def _bits(key: Column) -> Column:
    """BITS of 64 bits, from six bits of a hash each."""
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("bigint")
    for k in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return out


def words_for(rows: int) -> int | None:
    """Words for so many keys, or None where the filter would be too large to send."""
    n = max(1, rows // KEYS_A_WORD)
    return n if n <= MAX_WORDS else None


def build(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(_word, _mask): at most `words` rows."""
    return keys.select(_word(F.col(key), words).alias("_word"), _bits(F.col(key)).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))


def passing(rows: DataFrame, key: str, table: DataFrame, words: int) -> DataFrame:
    """Rows whose key may be among the filter's."""
    asked = rows.withColumns({"_word": _word(F.col(key), words), "_bit": _bits(F.col(key))})
    met = asked.join(F.broadcast(table), "_word").where(F.col("_mask").bitwiseAND(F.col("_bit")) == F.col("_bit"))
    return met.drop("_word", "_mask", "_bit")
