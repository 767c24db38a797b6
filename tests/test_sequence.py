import csv
import random

import pytest
from pyspark.sql import functions as F

from loomseq.functions import sequence as sq
from loomseq.functions import tokens as tk
from loomseq.sources import labelled_csv
from loomseq.sources.config import EncoderConfig
from loomseq.sources.dictionary import NgramDictionary


def one(spark, schema, *rows):
    return spark.createDataFrame(rows, schema)


def test_complement(spark):
    r = one(spark, "s string", ("ACGTNacgt",)).select(sq.complement(F.col("s")).alias("c"), sq.reverse_complement(F.col("s")).alias("r")).head()
    assert r.c == "TGCANacgt" and r.r == "tgcaNACGT"


@pytest.mark.parametrize("s,k,out", [("ACGTA", 3, "ACG CGT GTA"), ("ACG", 3, "ACG"), ("AC", 3, ""), ("", 3, ""), (None, 3, None)])
def test_kmers(spark, s, k, out):
    assert one(spark, "s string", (s,)).select(sq.kmer_str(F.col("s"), k)).head()[0] == out


def test_words_like_python(spark):
    r = random.Random(1)
    marks = [" ", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "a", "é", "z9", "​"]
    texts = ["".join(r.choice(marks) for _ in range(40)) for _ in range(50)] + ["", " "]
    got = one(spark, "i int, t string", *enumerate(texts)).select("i", sq.words(F.col("t")).alias("w")).collect()
    assert {x.i: x.w for x in got} == {i: t.split() for i, t in enumerate(texts)}


def test_csv_edge_rows(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text('h1,h2\n"AC""G,T",1\nACGT,0\n"a\\",2\n"",3\n"x\ny",4\n')
    got = sorted((r.label, r.sequence) for r in labelled_csv.read_labelled(spark, str(p)).collect())
    want = sorted((int(r[1]), r[0]) for r in list(csv.reader(p.open()))[1:])
    assert got == want


def test_csv_layouts(spark, tmp_path):
    for s in labelled_csv.SPLITS:
        (tmp_path / f"{s}.csv").write_text("a,b,c\nACGT,GG,1\nCC,TTTT,0\n")
    df = labelled_csv.read_splits(spark, str(tmp_path), {"train": 3})
    assert df.count() == 6 and df.where("split = 'train' and seq_a = 'ACG CGT'").count() == 1
    assert df.where("split = 'dev' and seq_a = 'ACGT'").count() == 1
    (tmp_path / "bad.csv").write_text("a\nACGT\n")
    with pytest.raises(ValueError):
        labelled_csv.read_labelled(spark, str(tmp_path / "bad.csv"))


def test_kmer_cache(spark, tmp_path):
    df = one(spark, "sequence string, label int", ("ACGT", 1))
    for _ in range(2):
        assert labelled_csv.cached_kmers(spark, df, str(tmp_path / "c"), ["sequence"], 3).head().sequence == "ACG CGT"


def test_dictionary_and_config(tmp_path):
    d = NgramDictionary(vocab={"A é": 5})
    d.save(str(tmp_path))
    assert NgramDictionary.load(str(tmp_path)) == d
    with pytest.raises(ValueError):
        NgramDictionary.load(str(tmp_path / "none"))
    c = EncoderConfig(hidden_size=64, num_hidden_ngram_layers=6)
    p = tmp_path / "config.json"
    p.write_text(c.to_json_string(use_diff=False))
    assert EncoderConfig.from_json_file(str(p)) == c
    assert '"max_ngram_count": 30' in c.to_json_string() and "intermediate_size" not in c.to_json_string()
    with pytest.raises(ValueError):
        EncoderConfig(num_hidden_ngram_layers=13)


def test_token_arrays(spark):
    df = one(spark, "x array<string>", (["a", "b", "c"],))
    c = tk.add_specials(tk.truncate(F.col("x"), 4), "[C]", "[S]")
    assert df.select(tk.pad_right(c, 6, "-")).head()[0] == ["[C]", "a", "b", "[S]", "-", "-"]
    assert df.select(tk.mask_of(tk.pad_right(c, 6, "-"), "-")).head()[0] == [1, 1, 1, 1, 0, 0]
    with pytest.raises(ValueError):
        tk.truncate(F.col("x"), 1)
    m = one(spark, "m array<array<int>>", ([[1, 0, 1], [0, 0, 1]],))
    t = tk.transpose(F.col("m"), 3)
    assert m.select(t).head()[0] == [[1, 0], [0, 0], [1, 1]]
    assert m.select(tk.transpose(t, 2)).head()[0] == [[1, 0, 1], [0, 0, 1]]
