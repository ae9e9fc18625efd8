"""Apply row-local operators (no aggregates, no actions) to a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def run_once(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Process what is there and stop; the checkpoint makes a second run take only what is new."""
    q = operator(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(out)
