"""Streams of chat chunks: what a reader sees, and the last state of each conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.operators.messages import printed_chunks

__all__ = ["latest_states", "printed_chunks"]


def latest_states(chunks: DataFrame) -> DataFrame:
    """conv_id and the content of its last `values` chunk so far; for output mode update or complete."""
    return chunks.filter("mode = 'values'").groupBy("conv_id").agg(F.max_by("content", "seq").alias("state"))
