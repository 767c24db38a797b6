"""Queries of this subpackage: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from loomseq.llm import funnel, html, langid, lattice, mixing, packing, quality, simhash, substring, tiff, toxicity, trie, urlfilter
from loomseq.llm.oracle import FUNNELS, ORACLE, RULES


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf):
    docs = _table(spark, sf, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, _table(spark, sf, "labels")))


def op2_simhash(spark, sf):
    from pyspark.sql import functions as F

    c = simhash.classes(_table(spark, sf, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark, sf):
    docs = _table(spark, sf, "documents")
    return quality.scores(docs, quality.fit(docs, _table(spark, sf, "labels")))


def op4_packing(spark, sf):
    return packing.pack(_table(spark, sf, "documents"))


def op5_tiff(spark, sf):
    return tiff.digest(_table(spark, sf, "documents"))


def op6_langid(spark, sf):
    docs = _table(spark, sf, "documents")
    return langid.predict(docs, langid.fit(docs))


def op7_mixing(spark, sf):
    return mixing.plan(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_embeddings(spark, sf):
    return lattice.classes(_table(spark, sf, "embeddings"))


def op9_html(spark, sf):
    return html.main_text(_table(spark, sf, "pages"))


def op10_substring(spark, sf):
    return substring.report(_table(spark, sf, "documents").select("doc_id", "text"))


def op11_trie(spark, sf):
    return trie.nodes(*trie.rebuilt(trie.numbered(_table(spark, sf, "conversations"))))


def op12_funnel(spark, sf):
    return funnel.counts(_table(spark, sf, "clicks"), [funnel.Funnel(*f) for f in FUNNELS])


def op13_urlfilter(spark, sf):
    return urlfilter.judge(_table(spark, sf, "pages"), urlfilter.rules_of(spark, *RULES))


def queries():
    import corpus_pipeline

    ops = [op1_toxicity, op2_simhash, op3_quality, op4_packing, op5_tiff, op6_langid, op7_mixing, op8_embeddings, op9_html, op10_substring, op11_trie, op12_funnel, op13_urlfilter]
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    """Votes over hashes, tokens, fits and flights have no SQL; tests compare with brute force."""
    return ORACLE
