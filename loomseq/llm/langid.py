"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of its typical words: those in at
least two sampled texts of the language and, relative to the texts, at least LIFT times as frequent
there as in any other; the most frequent stand last, where references to them are cheapest. Whole
sample texts as content would let a few mislabelled ones and their copies decide. Where a word is longer
than LONG characters, as sentences are in scripts without blanks, its runs of GRAM characters count as words.

A text is cut into blocks of BLOCK bytes, each is compressed with each dictionary, and the language
with the smallest sum wins. Ties go to the language with more training rows, then by name. The score
is the winner's share if sizes are taken as code lengths; a text whose score is below MARGIN is
marked as rejected.

About WANTED texts of each language, those with the lowest hash of doc_id, are the fitted sample,
and a dictionary holds at most DICTIONARY bytes; both bounds are parameters of the fit.
Texts that are null or have no letter (Unicode category L) are `und` with score 0, long ones are read whole.
Without training rows every text is `und`. lang, source and doc_id are no inputs of a prediction.
Rows that repeat are predicted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.llm.common import held_out, map_batches, materialise

MODULUS, REMAINDER = 4, 2
DICTIONARY, WANTED, LIFT, LEVEL, BLOCK, MARGIN = 1 << 16, 2000, 2.0, 9, 1024, 0.9
LONG, GRAM = 24, 4
_LETTER = regex.compile(r"\p{L}")


def fold(text: bytes) -> bytes:
    """Lower case and single blanks, so that a dictionary's words match wherever they stand."""
    return b" " + " ".join(text.decode("utf-8", "replace").lower().split()).encode() + b" "


@dataclass
class Dictionaries:
    """Languages in the order of preference, with the content of their dictionaries."""

    names: list[str]
    contents: list[bytes]

    def compressors(self):
        out = []
        for c in self.contents:
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def sizes(flat: bytes, compressors) -> np.ndarray:
    """Compressed size of all blocks by language."""
    blocks = [flat[c : c + BLOCK] for c in range(0, len(flat), BLOCK)]
    return np.array([sum(len(z.compress(b)) for b in blocks) for z in compressors], dtype=np.int64)


def decide(total: np.ndarray) -> tuple[int, float]:
    """First smallest, and its share of exp(-bits ln 2 / 4): a byte saved is two bits of evidence."""
    best = int(total.argmin())
    return best, float(1.0 / np.exp2(-2.0 * np.minimum(total - total[best], 400)).sum())


def parts(flat: str) -> set[str]:
    """The words of a folded text, or the runs of GRAM characters of long ones."""
    out = set()
    for w in set(flat.split()):
        if len(w) <= LONG:
            out.add(w)
        else:
            out.update(w[k : k + GRAM] for k in range(len(w) - GRAM + 1))
    return out


def content(words: list[str], size: int = DICTIONARY) -> bytes:
    """A dictionary of the words, most frequent first, as far as they fit; the first stand last."""
    kept, used = [], 2
    for w in words:
        used += len(w.encode()) + 1
        if used > size:
            break
        kept.append(w)
    return fold(" ".join(reversed(kept)).encode())


def fit(docs: DataFrame, wanted: int = WANTED) -> Dictionaries:
    """Dictionaries from rows with a language that aren't held out. The sample is drawn by a hash
    threshold that suits the number of a language's rows; words are counted on the executors, and
    only those in two texts or more come to the driver."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), MODULUS, REMAINDER)).select("doc_id", "lang", "text")
    total = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return Dictionaries([], [])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # The driver holds a row for each language and broadcasts these; texts aren't shuffled.
    share = docs.sparkSession.createDataFrame([(k, wanted / n) for k, n in total.items()], "lang string, share double")
    some = rows.where(draw < wanted / min(total.values())).join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text")

    def words(b: pa.RecordBatch):
        langs, found = [], []
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            own = {""} | parts(fold(t or b"").decode())  # the empty word counts texts
            langs += [lang] * len(own)
            found += own
        return {"lang": langs, "word": found}

    by = map_batches(some, words, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("k"))
    names = sorted(total, key=lambda x: (-total[x], x))
    typed = {r.lang: list(r.words) for r in _typical(materialise(by.where("k > 1 or word = ''"))).collect()}
    return Dictionaries(names, [content(typed.get(n, [])) for n in names])


def _typical(counts: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """(lang, words): by language, the words at least LIFT times as frequent there as in any other, the
    most frequent first, at most as many as a dictionary can hold. counts has the number of texts of a
    language that have a word; the empty word's is that of all its texts."""
    texts = F.broadcast(counts.where("word = ''").select("lang", F.col("k").alias("texts")))  # a row for each language
    rates = counts.where("word <> ''").join(texts, "lang").withColumn("rate", F.col("k") / F.col("texts"))
    ranked = rates.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("rate", "lang", "k")), False).alias("by"))  # an entry for each language
    best, next_ = F.get("by", F.lit(0)), F.coalesce(F.get("by", F.lit(1))["rate"], F.lit(0.0))
    clear = ranked.where(best["rate"] >= LIFT * next_).select("word", best["lang"].alias("lang"), best["k"].alias("k"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("k"), "word"))
    first = clear.withColumn("place", place).where(F.col("place") <= size // 2)
    words = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return first.groupBy("lang").agg(words.alias("words"))


def predict(docs: DataFrame, model: Dictionaries) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row."""
    ready = []
    names = model.names

    def run(b: pa.RecordBatch):
        if not ready:
            ready.append(model.compressors())
        known: dict[bytes | None, tuple] = {}
        out = []
        for t in b.column("text").cast(pa.binary()).to_pylist():
            if t not in known:
                flat = fold(t) if t else b""
                if not names or not _LETTER.search(flat.decode()):
                    known[t] = ("und", 0.0)
                else:
                    best, share = decide(sizes(flat, ready[0]))
                    known[t] = (names[best], share)
            out.append(known[t])
        return {"doc_id": b.column("doc_id"), "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "rejected": [x[1] < MARGIN for x in out]}

    got = map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double, rejected boolean")
    return got.withColumn("held_out", held_out(F.col("doc_id"), MODULUS, REMAINDER)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
