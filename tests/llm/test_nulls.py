"""Nulls in every column, and tables without rows, through every operator and stage."""

import pytest

from loomseq.llm import html, langid, mixing, packing, quality, simhash, substring, tiff, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROWS = [
    (None, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (1 << 60, "a b c d e f g", None, None, None), (3, None, "en", "s", 1),
    (4, "a b c d e f", None, "t", -5), (5, "", "de", None, 0), (5, "", "de", None, 0), (6, "w " * 60_000, "en", "s", 120_000),
]
LABELS = [(None, 1, 1), (3, None, None), (4, 1, 0), (1 << 60, 0, 1), (5, 1, 0)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


def test_scores(tables):
    docs, labels = tables
    m = toxicity.fit(docs, labels)
    assert toxicity.scores(docs, m).count() == len(ROWS)
    assert toxicity.keep_clean(docs, m).columns == docs.columns
    assert quality.scores(docs, quality.fit(docs, labels)).where("score between 0 and 1").count() == len(ROWS)
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(ROWS) and sum(x.lang_pred == "und" for x in got) == 4


def test_pairs(tables):
    docs, _ = tables
    c = {(x.doc_id, x.component_id) for x in simhash.classes(docs).collect()}
    assert (3, 3) in c and (5, 3) in c and (None, 3) in c and (1 << 60, 1 << 60) in c
    assert None not in {x.doc_id for x in simhash.dedup(docs).collect()}


def test_rest(tables):
    docs, _ = tables
    assert substring.report(docs).count() == len(ROWS) and substring.dedup(docs).columns == docs.columns
    assert tiff.digest(docs).count() == len(ROWS)
    pieces = packing.pack(docs).collect()
    assert sum(x.length for x in pieces) == sum(x.doc_tokens for x in pieces if x.start == 0)
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(ROWS) and sum(x.doc_id is None for x in plan) == 2 and any(x.doc_id == 1 << 60 for x in plan)
    assert mixing.mix(docs).count() == sum(x.times for x in plan)
    assert html.main_text(docs.selectExpr("doc_id as page_id", "source as url", "text as html", "lang as text")).count() == len(ROWS)
