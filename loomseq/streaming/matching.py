"""Dictionary hits over a stream of documents. Matching has no state across documents, so the batch
operator serves as it is; the dictionary is a static table joined to the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomseq.operators import ngrams
from loomseq.plans.records import Shape, tokenised


def stream_hits(stream: DataFrame, dictionary: DataFrame, shape: Shape = Shape(), dictionary_rows: int | None = None) -> DataFrame:
    """(doc_id, ngram, ngram_id, start, end) of each document as it arrives."""
    return ngrams.hits(tokenised(stream), "tokens", dictionary, shape.low, shape.high, dictionary_rows=dictionary_rows)


def write_hits(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet with exactly-once file commits, then stop when the source is drained."""
    return found.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
