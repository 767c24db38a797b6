"""Corpus preparation: toxicity, near-duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept."""

from __future__ import annotations

from loomseq.llm import mixing, nearcopies, packing, simhash, substring, toxicity
from loomseq.llm.common import drop_scratch, settled


def drop_toxic(spark, docs, sf_dir):
    """Documents that the factorization machine rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each component of fingerprints that link stays (SimHash); among these, so does one of each component
    of texts whose similarity over five words is 0.8 or more, compared exactly, which fingerprints can't find."""
    return nearcopies.dedup(simhash.dedup_rows(docs))


def drop_passages(spark, docs, sf_dir):
    """Passages that stand in an earlier document go from the later ones."""
    return substring.dedup(docs)


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def pack_tokens(spark, docs, sf_dir):
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring", drop_passages),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Fitted scores, hash votes and tokens can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each written and read again; a stage's input and the tables that it
    wrote on its way go once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs, path = settled(lambda: stage(spark, docs, sf_dir))
        if before:
            drop_scratch(spark, before)
        before = path
    return docs
