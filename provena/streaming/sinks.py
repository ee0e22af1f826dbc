"""Streams out: one batch to several places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fan_out(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None], trigger: dict | None = None) -> StreamingQuery:
    """Hand every micro-batch to all sinks.  A batch is repeated after a failure, so sinks take its number to know it again."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def counted(df: DataFrame, name: str, **metrics: str) -> DataFrame:
    """``df`` whose rows and given sums are observed while it runs, as metrics of that name."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(m) for m, c in metrics.items()])
