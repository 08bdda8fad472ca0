"""The stages over a stream, one micro-batch at a time (an addition: the batch functions are used as they are)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def map_stream(stream: DataFrame, mapper: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write mapper(batch) of each micro-batch to its own folder of path; a batch that runs again replaces its folder."""

    def put(batch: DataFrame, number: int) -> None:
        mapper(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
