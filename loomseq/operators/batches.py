"""Steps that make rows from rows alone, run one after the other in the same Arrow batches: a plan of several operators needs one
Python worker for each task, and what a step makes for the next doesn't travel to Spark's rows and back.

A step is a function of the types of its input's columns; it gives a function from batch to batch, and the types of that."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomseq.operators.ngrams import parts


def over(df: DataFrame, *steps) -> DataFrame:
    """df after all steps, as one pass."""
    types, runs = dict(df.dtypes), []
    for step in steps:
        run, types = step(types)
        runs.append(run)

    def every(batches):
        for b in parts(batches):
            if b.num_rows:
                for run in runs:
                    b = run(b)
                yield b

    return df.mapInArrow(every, ", ".join(f"`{c}` {kind}" for c, kind in types.items()))


def lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Flat values, and where each row's begin (and the last one's end); a null list has none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0)
    return column.flatten(), np.concatenate([[0], np.cumsum(np.asarray(sizes))]).astype(np.int64)


def listed(ends: np.ndarray, values, like: pa.ListArray) -> pa.ListArray:
    """A list column whose nulls are those of like."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=like.is_null() if like.null_count else None)
