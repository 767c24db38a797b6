"""Encoder configuration (SRC7, SNK5): sixteen scalars, JSON with sorted keys."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

#: Written even when they equal their defaults.
ALWAYS = ("num_hidden_ngram_layers", "max_ngram_count", "ngram_vocab_size", "alibi_starting_size")


@dataclass
class EncoderConfig:
    """The published defaults."""

    vocab_size: int = 30522
    hidden_size: int = 768
    num_hidden_layers: int = 12
    num_hidden_ngram_layers: int | None = None
    num_attention_heads: int = 12
    intermediate_size: int = 3072
    hidden_act: str = "gelu"
    hidden_dropout_prob: float = 0.1
    attention_probs_dropout_prob: float = 0.1
    max_position_embeddings: int = 512
    type_vocab_size: int = 2
    initializer_range: float = 0.02
    layer_norm_eps: float = 1e-12
    max_ngram_count: int = 30
    ngram_vocab_size: int = 162708
    alibi_starting_size: int = 512

    def __post_init__(self) -> None:
        if self.num_hidden_ngram_layers is not None and self.num_hidden_ngram_layers > self.num_hidden_layers:
            raise ValueError("n-gram layers must not outnumber token layers")

    @classmethod
    def from_dict(cls, data: dict, **ignored) -> EncoderConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})

    @classmethod
    def from_json_file(cls, path: str) -> EncoderConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    def to_json_string(self, use_diff: bool = True) -> str:
        """With use_diff, only what differs from the defaults, and the fields in ALWAYS."""
        plain = asdict(EncoderConfig())
        kept = {k: v for k, v in asdict(self).items() if not use_diff or k in ALWAYS or v != plain[k]}
        return json.dumps(kept, indent=4, sort_keys=True) + "\n"
