"""Row-wise operators need no state, so the same functions run on a streaming table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_stream(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply a row-wise operator (conversion, preparation, `forward`, `featurize`) to what is available and stop."""
    if not stream.isStreaming:
        raise ValueError("the input is not a stream")
    return (operator(stream).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
