"""String functions on symbolic sequences (STR1-STR4). All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's str.split() separates on, as a negated regex class.
#: The \x{..} escapes are read alike by Java and by RE2, so Spark and DuckDB share the pattern.
WORD = (
    r"[^\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def complement(seq: Column) -> Column:
    """Swap A with T and C with G; every other character stays. Does not reverse."""
    return F.translate(seq, "ATCG", "TAGC")


def reverse_complement(seq: Column) -> Column:
    """The biological reverse complement: complement() read backwards."""
    return F.reverse(complement(seq))


def kmer_str(seq: Column, k: int) -> Column:
    """Overlapping substrings of length k with stride 1, space-joined; '' when shorter than k."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return F.when(F.length(seq) >= k, F.array_join(kmers(seq, k), " ")).when(seq.isNotNull(), F.lit(""))


def kmers(seq: Column, k: int) -> Column:
    """The k-mers as an array; empty when the sequence is shorter than k."""
    grid = F.sequence(F.lit(1), F.length(seq) - (k - 1))
    return F.when(F.length(seq) >= k, F.transform(grid, lambda i: F.substring(seq, i, F.lit(k)))).when(
        seq.isNotNull(), F.array().cast("array<string>")
    )


def words(text: Column) -> Column:
    """Whitespace tokens, as Python's str.split() yields them."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
