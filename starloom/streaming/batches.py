"""Structured Streaming as a driver of the batch functions: each micro-batch is one landed batch.

An extension of the batch pipeline: no watermark, because late rows must reach the timeline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starloom.operators.history import timeline
from starloom.sources.store import Store
from starloom.spec import Spec


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``handle(rows, number)`` for what is available, exactly once for each number if ``handle`` can be repeated."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land_and_rebuild(store: Store, bronze: Spec, silver: Spec) -> Callable[[DataFrame, int], None]:
    """A handler that lands a micro-batch and publishes the timelines of all landed rows."""

    def handle(rows: DataFrame, number: int) -> None:
        landed = rows.withColumns({"_ingest_ts": F.lit(None).cast("timestamp"), "_source_file": F.lit("stream"), "_batch_id": F.lit(f"{number:010d}"), "_rescued_data": F.lit(None).cast("string")})
        store.replace_batch(landed, bronze, f"{number:010d}")
        every = store.read(bronze).select(*[F.col(a.name).try_cast(a.data_type).alias(a.name) for a in silver.attributes])
        store.publish(timeline(every, list(silver.business_key), silver.sequence_by, silver.tracked), silver)

    return handle
