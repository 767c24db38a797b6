"""Encoded records (CMP2, CMP3): token half and n-gram half of a document, joined by key."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.functions import tokens as tk
from loomseq.functions.sequence import words
from loomseq.operators import ngrams as ng
from loomseq.operators.batches import over


@dataclass(frozen=True)
class Shape:
    """The sequence length and dictionary limits that the encoder expects."""

    max_seq_length: int = 512
    low: int = 2
    high: int = 5
    cap: int = 30
    pad_ngram_id: int = 0


#: Ids of the special tokens in a corpus vocabulary.
SPECIALS = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "[MASK]": 4}
#: Fixed value: the published number of n-grams and of tokens.
NGRAM_VOCAB, TOKEN_VOCAB = 162_708, 4_096


def tokenised(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer=words) -> DataFrame:
    """(key, tokens); tokenizer is any function from a text column to an array of strings. An array
    of texts (a sequence pair) is tokenised one by one and concatenated. A null text has no tokens."""
    kind = dict(docs.dtypes)[key]
    is_list = dict(docs.dtypes)[text].startswith("array")
    if tokenizer is words and not is_list:
        return docs.select(key, text).mapInArrow(_split, f"`{key}` {kind}, tokens array<string>")
    toks: Column = F.flatten(F.transform(text, tokenizer)) if is_list else tokenizer(F.col(text))
    return docs.select(key, F.coalesce(toks, F.array().cast("array<string>")).alias("tokens"))


def _split(batches):
    """words() of the second column: str.split() separates on the same characters, at a small part of the pattern's cost."""
    for b in ng.parts(batches):
        lists = pa.array([[] if t is None else t.split() for t in b.column(1).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[b.schema.names[0], "tokens"])


def from_words(docs: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """Documents that are split into words already; the column must be an array of strings."""
    if dict(docs.dtypes)[column] != "array<string>":
        raise ValueError("pre-split input must be an array of strings")
    return docs.select(key, F.col(column).alias("tokens"))


def corpus_tokens(docs: DataFrame, size: int = TOKEN_VOCAB) -> DataFrame:
    """(token, id): the most frequent tokens, ties by string, numbered after the special ones. Tokens are counted in Arrow
    batches before they become rows."""

    def run(batches):
        for _, flat, _ in ng.slices(batches, "tokens"):
            counted = pc.value_counts(flat)
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["token", "n"])

    counts = docs.select("tokens").mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(size - len(SPECIALS))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return top.select("token", (rank + (len(SPECIALS) - 1)).cast("int").alias("id"))


def _vocabulary(vocab: DataFrame) -> tuple[pa.Array, pa.Array]:
    """Tokens, and their ids with the unknown one at the end."""
    rows = vocab.select("token", "id").limit(TOKEN_VOCAB + 1).collect()
    if len(rows) > TOKEN_VOCAB:
        raise ValueError("the vocabulary has more tokens than the model")
    known = {r.token: r.id for r in rows} | SPECIALS
    return pa.array(list(known), pa.string()), pa.array([*known.values(), SPECIALS["[UNK]"]], pa.int32())


def _framed(flat: pa.Array, sizes: np.ndarray, names: pa.Array, ids: pa.Array, length: int) -> tuple[pa.Array, pa.Array]:
    """Lists of ids and of the mask: each row between its special tokens, and padded to length (0: not at all)."""
    at = pc.fill_null(pc.index_in(flat, value_set=names), len(names))
    full = np.maximum(sizes + 2, length)
    offsets = np.concatenate([[0], np.cumsum(full)])
    begins = offsets[:-1]
    found = np.full(offsets[-1], SPECIALS["[PAD]"], np.int32)
    mask = np.zeros(offsets[-1], np.int32)
    place = np.arange(len(flat)) + np.repeat(begins + 1 - (np.cumsum(sizes) - sizes), sizes)
    found[place] = np.asarray(ids.take(at))
    mask[place] = np.asarray(pc.fill_null(pc.not_equal(flat, "[PAD]"), True)).astype(np.int32)
    for ends, token in ((begins, "[CLS]"), (begins + sizes + 1, "[SEP]")):
        found[ends], mask[ends] = SPECIALS[token], 1
    return tuple(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (found, mask))


def _mapped(docs: DataFrame, shape: Shape, cols: list[str], made, schema: dict[str, str], then: tuple = ()) -> DataFrame:
    """cols of docs and what made(flat tokens, sizes) gives for truncated tokens, ng.ROWS rows at a time, so that a worker
    never holds the padded arrays of a whole Arrow batch; then further steps, see batches.py."""
    if shape.max_seq_length < 2:
        raise ValueError("max_seq_length must leave room for two special tokens")

    def run(b):
        columns = made(*ng.split(b.column("tokens"), shape.max_seq_length - 2))
        return pa.RecordBatch.from_arrays([b.column(c) for c in cols] + list(columns), names=[*cols, *schema])

    return over(docs.select(*cols, "tokens"), lambda types: (run, {c: types[c] for c in cols} | schema), *then)


#: Columns of a record.
HALF = {"input_ids": "array<int>", "attention_mask": "array<int>"}
NGRAMS = {"ngrams": "array<struct<id:int,pos:array<int>>>"}


def token_half(docs: DataFrame, vocab: DataFrame, shape: Shape, pad: bool = True, key: str = "doc_id", keep: tuple[str, ...] = (), then: tuple = ()) -> DataFrame:
    """(key, keep..., input_ids, attention_mask): truncated, with special tokens, padded, mapped to ids,
    one row for each row of docs, whatever its key.

    vocab must have at most TOKEN_VOCAB rows, as corpus_tokens() makes it: the driver reads that many and
    sends them to the workers, which look up whole Arrow batches of tokens; nothing is shuffled."""
    names, ids = _vocabulary(vocab)
    length = shape.max_seq_length if pad else 0
    return _mapped(docs, shape, [key, *keep], lambda flat, sizes: _framed(flat, sizes, names, ids, length), HALF, then)


def masks(docs: DataFrame, shape: Shape, key: str = "doc_id") -> DataFrame:
    """(key, attention_mask) of token_half(): it depends on no id, so no vocabulary is counted for it."""
    none, unknown = pa.array([], pa.string()), pa.array([SPECIALS["[UNK]"]], pa.int32())
    return _mapped(docs, shape, [key], lambda flat, sizes: _framed(flat, sizes, none, unknown, shape.max_seq_length)[1:], {"attention_mask": "array<int>"})


def _dictionary(dictionary: DataFrame, bound: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct n-grams, where the ids of each begin (and the last's end), and ids."""
    rows = dictionary.select("ngram", "ngram_id").limit(bound + 1).toArrow()
    if rows.num_rows > bound:
        raise ValueError("the dictionary has more n-grams than its bound")
    coded = pc.dictionary_encode(pa.concat_arrays([pa.array([], pa.string()), *rows.column("ngram").chunks]))
    nth, ids = np.asarray(coded.indices), np.asarray(rows.column("ngram_id")).astype(np.int64)
    order = np.argsort(nth, kind="stable")
    return coded.dictionary, np.searchsorted(nth[order], np.arange(len(coded.dictionary) + 1)), ids[order]


def records(docs: DataFrame, vocab: DataFrame, dictionary: DataFrame, shape: Shape = Shape(), pad: bool = True, key: str = "doc_id", then: tuple = ()) -> DataFrame:
    """(key, input_ids, attention_mask, ngrams); documents without a hit have an empty list. Rows that
    share a key but not the tokens are documents of their own.

    Vocabulary and dictionary have at most TOKEN_VOCAB and NGRAM_VOCAB rows, which are sent to the workers, as the model's
    own tables are; a record is made from its row alone, and nothing is shuffled or joined.
    Further steps (then) work on records in the same batches."""
    names, ids = _vocabulary(vocab)
    sent = docs.sparkSession.sparkContext.broadcast(_dictionary(dictionary, NGRAM_VOCAB))
    length = shape.max_seq_length if pad else 0

    def made(flat, sizes):
        return *_framed(flat, sizes, names, ids, length), ng.ranked_lists(flat, sizes, *sent.value, shape.low, shape.high, shape.cap, shape.max_seq_length)

    return _mapped(docs, shape, [key], made, HALF | NGRAMS, then)


def matched(docs: DataFrame, keys: DataFrame, dictionary: DataFrame, shape: Shape = Shape(), key: str = "doc_id") -> DataFrame:
    """What ng.match() gives of truncated documents: (key, ngram_id, positions, rk).

    Where no key is repeated (keys has those of docs), it is made from each row alone, and no token is shuffled. Else
    rows that share a key have to meet."""
    if _repeated(keys, key):
        return _met(docs, dictionary, shape, key)
    lists = _lists(docs, dictionary, shape, key).select(key, F.posexplode("ngrams").alias("nth", "g"))
    return lists.select(key, F.col("g.id").alias("ngram_id"), F.col("g.pos").alias("positions"), (F.col("nth") + 1).alias("rk"))


def matched_lists(docs: DataFrame, keys: DataFrame, dictionary: DataFrame, shape: Shape = Shape(), key: str = "doc_id", then: tuple = ()) -> DataFrame:
    """matched() as (key, ngrams): one row for each key, in rank order, `cap` n-grams at most; then further steps, see
    batches.py. Where no key is repeated, all of it is one pass and nothing is shuffled."""
    if not _repeated(keys, key):
        return _lists(docs, dictionary, shape, key, then)
    one = F.struct("rk", F.struct(F.col("ngram_id").alias("id"), F.col("positions").alias("pos")).alias("g"))
    met = _met(docs, dictionary, shape, key).groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_all"))
    return over(met.select(key, F.col("_all.g").alias("ngrams")), *then)


def _repeated(keys: DataFrame, key: str) -> bool:
    return not keys.groupBy(key).count().where("count > 1").isEmpty()


def _met(docs: DataFrame, dictionary: DataFrame, shape: Shape, key: str) -> DataFrame:
    cut = tokenised(docs, "tokens", key) if dict(docs.dtypes)["tokens"] == "string" else docs
    cut = cut.select(key, tk.truncate(F.col("tokens"), shape.max_seq_length).alias("tokens"))
    return ng.match(cut, "tokens", dictionary, shape.low, shape.high, shape.cap, shape.max_seq_length, key, dictionary_rows=NGRAM_VOCAB)


def _lists(docs: DataFrame, dictionary: DataFrame, shape: Shape, key: str, then: tuple = ()) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(_dictionary(dictionary, NGRAM_VOCAB))

    def made(flat, sizes):
        return (ng.ranked_lists(flat, sizes, *sent.value, shape.low, shape.high, shape.cap, shape.max_seq_length),)

    return _mapped(docs, shape, [key], made, NGRAMS, then)


def dense(recs: DataFrame, shape: Shape = Shape(), pad: bool = True) -> DataFrame:
    """Adds ngram_input_ids, ngram_attention_match (one row an n-gram) and ngram_attention_mask."""
    rows = F.lit(shape.cap) if pad else F.greatest(F.lit(1), F.size("ngrams"))
    length = F.size("input_ids")
    missing = F.greatest(F.lit(0), rows - F.size("ngrams"))
    ids = F.concat(F.col("ngrams.id"), F.array_repeat(F.lit(shape.pad_ngram_id), missing))
    match = F.concat(
        F.transform("ngrams", lambda g: tk.dense_row(g["pos"], length)),
        F.array_repeat(F.array_repeat(F.lit(0), length), missing),
    )
    return recs.withColumn("ngram_input_ids", ids).withColumns({
        "ngram_attention_match": match, "ngram_attention_mask": tk.mask_of(F.col("ngram_input_ids"), shape.pad_ngram_id)
    })


def model_ready(dense_records: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The record a model takes: position matrix, zero type ids, boolean n-gram mask. The matrix is
    made from the positions, as transposing the match matrix would make that anew for each row."""
    missing = F.size("ngram_input_ids") - F.size("ngrams")
    by_position = F.transform(
        F.sequence(F.lit(0), F.size("input_ids") - 1),
        lambda p: F.concat(
            F.transform("ngrams", lambda g: F.array_contains(g["pos"], p).cast("int")), F.array_repeat(F.lit(0), missing)
        ),
    )
    return dense_records.withColumns({
        "ngram_position_matrix": by_position,
        "ngram_token_type_ids": F.transform("ngram_input_ids", lambda _: F.lit(0)),
        "ngram_attention_mask": F.transform("ngram_attention_mask", lambda m: m == 1),
    }).drop("ngram_attention_match", "ngrams")
