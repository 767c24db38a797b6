"""Splittable CSV, subword tokens, Bloom filter, against Python's csv, the public tokenizer and loops."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from loomseq.operators import bloom, ngrams, subword
from loomseq.sources import records as rec

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def written(tmp_path, text, name="t.csv"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


@pytest.fixture
def split(spark):
    """The bytes that a task reads at most."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "1")

    yield to
    for n, v in old.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


F1 = 'sequence,label\n"AC""G,T",1\nACGT,0\n"a\\",2\n"",3\n"x\ny",4\n"\n\n""\n"" ,\n", 5 \r\n,6\n"ä,é\r\nü",-7\n'


def test_every_border(spark, tmp_path, split):
    path = written(tmp_path, F1)
    want = [(r[0], int(r[1])) for r in csv.reader(io.StringIO(F1.replace("\r\n", "\n"))) if r[1:] and r[1] != "label"]
    assert len(want) == 8
    for size in (2, 7, 23):
        split(size)
        good, bad = rec.read_labelled(spark, path)
        assert bad.collect() == [] and good.columns == ["row_id", "sequence", "label"]
        assert [(r.sequence, r.label) for r in good.orderBy("row_id").collect()] == want, size
    split(7)
    assert rec.lines(spark, path).rdd.getNumPartitions() > 5


def test_random_files_like_python(spark, tmp_path, split):
    rng, rows = random.Random(4), []
    for k in range(400):
        rows.append(["".join(rng.choice('ab,"\n é') for _ in range(rng.randrange(12))), "".join(rng.choice('x"\n') for _ in range(rng.randrange(4))), k])
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["a", "b", "c"], *rows])
    for size in (333,):
        split(size)
        good, bad = rec.read_labelled(spark, written(tmp_path, out.getvalue()))
        assert bad.count() == 0 and [tuple(r)[1:] for r in good.orderBy("row_id").collect()] == [tuple(r) for r in rows]


def test_errors_are_kept_apart(spark, tmp_path):
    text = 'h,l\nA,1\nB\nC,x\nD,2,more\n\nE, 3\t\nF,99999999999\nG"g,4\n"G"h,5"\nH,6\n"' + "I\n" * 50
    good, bad = rec.read_labelled(spark, written(tmp_path, text), max_record=40)
    assert [(r.sequence, r.label) for r in good.orderBy("row_id").collect()] == [("A", 1), ("D", 2), ("E", 3), ("H", 6)]
    assert sorted((r.raw, r.problem) for r in bad.collect()) == sorted([
        ("B", "too few fields"), ("C,x", "label is not an integer"), ("F,99999999999", "label is not an integer"),
        ('G"g,4\n"G"h,5"', "stray quote"), ('"I', "record too long"),
    ])


def test_layouts_and_splits(spark, tmp_path):
    for text in ("h\nA\n", "h\nA,B,C,1\n", "h,l\n", ""):
        with pytest.raises(ValueError):
            rec.read_labelled(spark, written(tmp_path, text))
    for s in rec.SPLITS:
        written(tmp_path, f'a,b,l\nACGT,"{s}",1\nbad,2\n', f"{s}.csv")
    good, bad = rec.read_splits(spark, str(tmp_path), {"train": 3})
    assert sorted((r.split, r.seq_a, r.seq_b) for r in good.collect()) == [("dev", "ACGT", "dev"), ("test", "ACGT", "test"), ("train", "ACG CGT", "tra rai ain")]
    assert sorted(r.split for r in bad.collect()) == ["dev", "test", "train"]


# --- subword tokens ------------------------------------------------------------------------------


def slow_pieces(model, word):
    """Merge the lowest pair, leftmost first, and look again."""
    out = [subword.byte_letters()[b] for b in word.encode()]
    if out:
        out[-1] += model.suffix
    while len(out) > 1:
        rank, i = min((model.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(out, out[1:])))
        if rank == 1 << 60:
            break
        out[i : i + 2] = [out[i] + out[i + 1]]
    return out


@pytest.mark.parametrize("suffix", ["", "</w>"])
def test_merges_like_loops(suffix):
    rng = random.Random(2)
    letters = ["a", "b", "c", *(x + suffix for x in "abc" if suffix)]
    known, ranks = set(letters), {}
    for _ in range(60):
        a, b = rng.choice(sorted(known)), rng.choice(sorted(known))
        if not (suffix and a.endswith(suffix)):
            ranks.setdefault((a, b), len(ranks))
            known.add(a + b)
    model = subword.Merges({p: i for i, p in enumerate(sorted(known))}, ranks, suffix)
    for _ in range(400):
        w = "".join(rng.choice("aaabbc") for _ in range(rng.randrange(30)))
        assert model.pieces(w) == slow_pieces(model, w)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_encode_like_the_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Hello  world's  end\n\n x", "", None, "don't  stop\t12345 ½ äöü", "ACGTACGTAC" * 30, "日本語 テスト 　x", "a" * 5000, "  lead", "trail  ", "👍🏽 ok", "it's"]
    whole = tokenizers.Tokenizer.from_file(VOCABULARY)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r.ids for r in subword.encode(df, subword.Merges.load(VOCABULARY)).collect()}
    assert got == {k: whole.encode(t, add_special_tokens=False).ids if t else [] for k, t in enumerate(texts)}


# --- a dictionary beyond the broadcast bound -----------------------------------------------------


def test_bloom_keeps_all_members(spark):
    keys = spark.range(0, 20_000, 2).withColumnRenamed("id", "k")
    words = bloom.words_for(10_000)
    table = bloom.build(keys, "k", words)
    assert table.count() <= words
    through = bloom.passing(spark.range(20_000).withColumnRenamed("id", "k"), "k", table, words)
    assert through.columns == ["k"] and through.where("k % 2 = 0").count() == 10_000
    assert through.where("k % 2 = 1").count() < 600
    assert bloom.words_for(10**9) is None


def test_large_dictionary_is_filtered_and_shuffled(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]) for k in range(60)], "doc_id int, tokens array<string>")
    entries = [(" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 3]))), k) for k in range(40)]
    words = spark.createDataFrame(list({g: (g, k) for g, k in entries}.values()), "ngram string, ngram_id int")
    want = ngrams.hits(docs, "tokens", words, 2, 4, dictionary_rows=50)
    for rows in (None, 600_000, 10**9):
        got = ngrams.hits(docs, "tokens", words, 2, 4, dictionary_rows=rows)
        assert sorted(got.collect()) == sorted(want.collect())
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ngrams.hits(docs, "tokens", words, 2, 4, dictionary_rows=600_000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1 and "_mask" in plan
    kept = ngrams.filtered_windows(docs, "tokens", words, 2, 4, dictionary_rows=600).count()
    assert want.count() <= kept < ngrams.windows(docs, "tokens", 2, 4).count() / 4
