"""Metrics sinks (SNK2, SNK3). The frames have one row per evaluation, so the driver writes them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame


def write_history(history: DataFrame, folder: str, name: str = "eval_results.json") -> str:
    """One JSON object keyed by epoch_key; other columns are the metrics. Rewritten as a whole."""
    data = {}
    for row in history.collect():
        record = row.asDict()
        data[record.pop("epoch_key")] = record
    return _dump(data, folder, name)


def write_final(metrics: DataFrame, folder: str, name: str = "final_eval_results.json") -> str:
    return _dump(metrics.head().asDict(), folder, name)


def _dump(data: dict, folder: str, name: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=4)
    return path
