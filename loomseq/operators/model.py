"""The whole model over records (section 2.13 of the survey): embeddings, encoder with n-gram fusion,
pooler, and the heads for classification and masked tokens.

A record is a row of plans.records: input_ids, attention_mask and ngrams (array<struct<id, pos>>). Rows
go through in Arrow batches, one sequence at a time; nothing is shuffled. The weights travel with the
function, as a model that fits a worker does."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomseq.operators.batches import lists, over
from loomseq.operators.encoder import UNSHIFTED, BlockWeights, PlainWeights, forward, gelu, linear, norm

Scale = tuple[np.ndarray, np.ndarray]


@dataclass
class Model:
    """Tables have a row for each id; row 0 of gram_table counts as zeros (padding). The decoder is the
    token table itself, with a bias of its own."""

    tokens: np.ndarray
    token_type: np.ndarray
    layers: list[BlockWeights]
    gram_table: np.ndarray
    gram_type: np.ndarray
    gram_layers: list[PlainWeights]
    pooler: tuple[np.ndarray, np.ndarray]
    transform: tuple[np.ndarray, np.ndarray]
    decoder_bias: np.ndarray
    classifier: tuple[np.ndarray, np.ndarray]
    token_norm: Scale | None = None
    gram_norm: Scale | None = None
    transform_norm: Scale | None = None

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return norm(self.tokens[ids] + self.token_type, self.token_norm)

    def embed_grams(self, ids: np.ndarray) -> np.ndarray:
        known = np.where((ids != 0)[:, None], self.gram_table[ids], 0.0)
        return norm(known + self.gram_type, self.gram_norm)

    def hidden(self, ids, mask, grams, subset=None) -> np.ndarray:
        """grams: (id, positions) in rank order; none of them leaves the tokens alone."""
        ids, mask = np.asarray(ids), np.asarray(mask)
        live = mask == 1
        kinds = np.unique(ids[live], return_inverse=True)[1]  # tokens with one id are alike, up to the first layer's bias
        x = np.zeros((len(ids), len(self.token_type)))
        x[live] = self.embed(ids[live])
        if not grams or not self.gram_layers:
            return forward(x, mask, self.layers, subset=subset, kinds=kinds)
        names = np.array([g for g, _ in grams])
        incidence = np.zeros((len(ids), len(grams)))
        for k, (_, at) in enumerate(grams):
            incidence[at, k] = 1.0
        return forward(x, mask, self.layers, self.embed_grams(names), (names != 0).astype(float), incidence, self.gram_layers, subset, kinds)

    def pooled(self, hidden: np.ndarray) -> np.ndarray:
        return np.tanh(linear(hidden[0], *self.pooler))

    def classify(self, hidden: np.ndarray) -> np.ndarray:
        return linear(self.pooled(hidden), *self.classifier)

    def decoded(self, hidden: np.ndarray) -> np.ndarray:
        return norm(gelu(linear(hidden, *self.transform)), self.transform_norm)

    def token_logits(self, hidden: np.ndarray) -> np.ndarray:
        return self.decoded(hidden) @ self.tokens.T + self.decoder_bias

    @classmethod
    def fixed(cls, vocab: int, gram_vocab: int, dim: int, inner: int, heads: int, depth: int, gram_depth: int, labels: int, seed: int) -> Model:
        """Small repeatable weights, with every bias and norm, for tests and demonstrations."""
        r = np.random.default_rng(seed)
        make = lambda *s: r.normal(0.0, 0.1, s)
        scale = lambda: (1.0 + make(dim), make(dim))
        layers = [BlockWeights(make(dim, 3 * dim), make(dim, dim), make(dim, 2 * inner), make(inner, dim), heads, make(3 * dim), make(dim), make(dim), scale(), scale()) for _ in range(depth)]
        grams = [PlainWeights(make(dim, 3 * dim), make(dim, dim), make(dim, inner), make(inner, dim), heads, make(3 * dim), make(dim), make(inner), make(dim), scale(), scale()) for _ in range(gram_depth)]
        square = lambda: (make(dim, dim), make(dim))
        return cls(make(vocab, dim), make(dim), layers, make(gram_vocab, dim), make(dim), grams, square(), square(), make(vocab), (make(dim, labels), make(labels)), scale(), scale(), scale())


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    """The list of each row as an array, without an object for each element."""
    flat, ends = lists(column)
    return np.split(np.asarray(flat), ends[1:-1])


def _over(key: str, columns: list[str], one, schema: dict[str, str]):
    """A step: one(ids, mask, grams, further columns...) for each record, as a row after its key."""
    of = {"array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}

    def run(b):
        grams, ends = lists(b.column("ngrams"))
        each = list(zip(np.asarray(grams.field("id")), _rows(grams.field("pos")))) if len(grams) else []
        rows = [one(ids, mask, each[begin:end], *more) for begin, end, ids, mask, *more in zip(ends[:-1], ends[1:], *(_rows(b.column(c)) for c in ["input_ids", "attention_mask", *columns]))]
        made = {c: pa.array(list(x), type=of[kind]) for (c, kind), x in zip(schema.items(), zip(*rows))}
        return pa.RecordBatch.from_pydict({key: b.column(key)} | made)

    return lambda types: (run, {key: types[key]} | schema)


def classify(records: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, logits): the pooled first position through the classifier."""
    return over(records, classified(model, key))


def classified(model: Model, key: str = "doc_id"):
    """classify() as a step, see batches.py; the last layer makes the first position alone."""

    def one(ids, mask, grams):
        # A first position that isn't attended to stays 0.
        first = model.hidden(ids, mask, grams, np.array([0])) if len(ids) and mask[0] == 1 else np.zeros((1, len(model.token_type)))
        return (model.classify(first).tolist(),)

    return _over(key, [], one, {"logits": "array<double>"})


#: Masked tokens whose logits are held at a time.
LOGITS = 16


def _losses(model: Model, made: np.ndarray, want: np.ndarray) -> tuple[list[int], list[float]]:
    """For each hidden vector the likeliest token, and the cross-entropy of the one wanted."""
    predicted, losses = [], []
    made = model.decoded(made)
    for c in range(0, len(made), LOGITS):
        z = made[c : c + LOGITS] @ model.tokens.T
        z += model.decoder_bias
        nth, best = np.arange(len(z)), z.argmax(1)
        top = z[nth, best]
        wanted = z[nth, want[c : c + LOGITS]]
        if (np.abs(top) <= UNSHIFTED).all():
            top[:] = 0.0
        else:
            z -= top[:, None]
        predicted += best.tolist()
        losses += (np.log(np.exp(z, out=z).sum(1)) + top - wanted).tolist()
    return predicted, losses


def masked_tokens(records: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, positions, predicted, losses) where labels are over 0; the last layer makes these positions alone."""
    return over(records, scored(model, key))


def scored(model: Model, key: str = "doc_id"):
    """masked_tokens() as a step, see batches.py."""

    def one(ids, mask, grams, labels):
        at = np.nonzero((labels > 0) & (mask == 1))[0]
        return (at, *_losses(model, model.hidden(ids, mask, grams, at), labels[at])) if len(at) else ([], [], [])

    return _over(key, ["labels"], one, {"positions": "array<int>", "predicted": "array<int>", "losses": "array<double>"})
