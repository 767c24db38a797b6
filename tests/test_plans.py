"""Plans: pruned scans, broadcast only with a bound, no cartesian product, one shuffle for matching."""

import os
import re

import pytest
from pyspark.sql import functions as F

from loomseq.operators import ngrams
from loomseq.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["tok_encode", "ngram_match_topk", "mask_whole_ngram", "ragged_pad"])
def test_scans_are_pruned(spark, name):
    p = plan(QUERIES[name](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all("source" not in s and "lang" not in s and "n_chars" not in s for s in schemas)
    assert "CartesianProduct" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def parts(spark):
    d = spark.createDataFrame([(1, ["a", "b"])], "doc_id bigint, tokens array<string>")
    return d, spark.createDataFrame([("a b", 1)], "ngram string, ngram_id int")


def test_dictionary_is_broadcast_only_with_a_bound(spark):
    d, v = parts(spark)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(ngrams.hits(d, "tokens", v, 2, 3, dictionary_rows=10))
        assert "BroadcastHashJoin" not in plan(ngrams.hits(d, "tokens", v, 2, 3))
        assert "BroadcastHashJoin" not in plan(ngrams.hits(d, "tokens", v, 2, 3, dictionary_rows=10**9))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_matching_shuffles_once(spark):
    d, v = parts(spark)
    p = plan(ngrams.match(d, "tokens", v, 2, 3, 30, 64, dictionary_rows=10))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1


def test_results_do_not_depend_on_partitions(spark):
    rows = [(k, [f"t{(k * j) % 7}" for j in range(20)]) for k in range(50)]
    d = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    v = ngrams.corpus_dictionary(d, "tokens", 2, 3, 2, 100)
    one = ngrams.match(d, "tokens", v, 2, 3, 5, 64, dictionary_rows=100)
    other = ngrams.match(d.repartition(9, F.rand(1)), "tokens", v, 2, 3, 5, 64)
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
