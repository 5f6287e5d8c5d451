"""Projection of a stream: it keeps no state, so the batch operator works on streams as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.projection import Projection


def start_projection(projection: Projection, stream: DataFrame, output: str, checkpoint: str, embedding: str = "embedding") -> StreamingQuery:
    """Write each arriving row with its coordinates to Parquet, once, until the source has no more at hand."""
    rows = projection.project(stream, embedding)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
