"""Matching a stream of inputs against an index: an extension, as the matcher itself works on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def match_stream(inputs: DataFrame, match: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that matches each micro-batch of ``inputs`` (address_id, address) and writes a folder per batch under ``path``.

    A batch that is run again replaces its own folder, so results are there exactly once.
    """

    def each(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return inputs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
