"""Streaming ingestion: vectors are encoded, and assigned to lists, as they arrive. Row by row, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators import ivf
from lodestar.operators.encode import encode
from lodestar.operators.index import Index


def encoded_stream(vectors: DataFrame, index: Index) -> DataFrame:
    """Codes of a stream of vectors(vec_id, embedding), by the frozen codebook and lists of an index."""
    if index.centroids is None:
        return encode(vectors, index.model)
    return ivf.encode_lists(vectors, index.centroids, index.model)


def append_stream(vectors: DataFrame, index: Index, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to the codes of a saved index; what is there when it starts is taken, then it ends.

    Each micro-batch is an ordinary append: the file sink would keep a log that hides the files the index was saved with. A
    batch that is repeated after a failure is appended again, so readers that need each row once drop repeated vec_ids."""
    by = [] if index.centroids is None else ["list_id"]

    def append(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").partitionBy(*by).parquet(f"{path}/codes")

    writer = encoded_stream(vectors, index).writeStream.foreachBatch(append)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
