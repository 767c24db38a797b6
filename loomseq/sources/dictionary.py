"""N-gram dictionaries (SRC4, SRC5, SNK4): JSON on disk, a small dimension table in Spark."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FILE_NAME = "ngram.json"


@dataclass
class NgramDictionary:
    """The defaults of the file format."""

    min_ngram_len: int = 2
    max_ngram_len: int = 5
    max_ngram_count: int = 30
    pad_ngram_id: int = 0
    pad_ngram: str = "<PAD>"
    ngram_size: int | None = None
    vocab: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, folder: str) -> NgramDictionary:
        path = os.path.join(folder, FILE_NAME)
        if not os.path.exists(path):
            raise ValueError(f"{FILE_NAME} not found in {folder}")
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        return cls(**{k: data[k] for k in cls.__dataclass_fields__ if k in data})

    def save(self, folder: str) -> str:
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, FILE_NAME)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(vars(self), f, ensure_ascii=False, indent=2)
        return path

    def frame(self, spark: SparkSession) -> DataFrame:
        """(ngram, ngram_id); the driver holds it already, so its size is known."""
        return spark.createDataFrame(list(self.vocab.items()), "ngram string, ngram_id int")
