"""Images that arrive as a stream: each micro-batch runs the same kernels as a table does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvagrid.operators.edits import alternating
from silvagrid.plans.tree import Tree, max_tree


def tree_stream(pixels: DataFrame, sink: Callable[[Tree, int], None], checkpoint: str, build: Callable[[DataFrame], Tree] = max_tree):
    """Start a query over a stream of pixels of whole images; sink(tree, batch) is called for every batch. The
    source must bring all pixels of an image in one batch (a file or a message for an image)."""
    return pixels.writeStream.foreachBatch(lambda batch, i: sink(build(batch), i)).option("checkpointLocation", checkpoint).start()


def filtered_stream(pixels: DataFrame, path: str, checkpoint: str, thresholds: list[float], measure: str = "AREA"):
    """Alternating filters of each arriving image, appended to a Parquet table."""
    return pixels.writeStream.foreachBatch(lambda batch, _: alternating(batch, thresholds, measure).write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).start()


def event_grid(events: DataFrame, ts: str = "ts", window: str = "1 day", delay: str = "1 hour", users: int = 24) -> DataFrame:
    """Counts of events by hour and user group for each window of event time: one image a window. Works on a table
    and, with a watermark for late rows, on a stream."""
    e = events.withWatermark(ts, delay) if events.isStreaming else events
    cells = e.groupBy(F.window(ts, window).alias("w"), F.hour(ts).alias("row"), F.pmod(F.col("user_id"), F.lit(users)).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("value"))
    return cells.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("image_id"), "row", "col", "value")
