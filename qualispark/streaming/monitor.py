"""A running control monitor: flags of arriving points against fixed limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_signals(stream: DataFrame, ts: str, value: str, center: float, sigma: float, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Points and signals (beyond three sigma) in each window, late rows up to ``delay``.

    Works on a stream and on a table alike.
    """
    own = stream.select(F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("x")).filter("x is not null")
    if own.isStreaming:
        own = own.withWatermark("ts", delay)
    out = F.abs(F.col("x") - center) > 3 * sigma
    g = own.groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), F.count_if(out).alias("signals"), F.avg("x").alias("mean"))
    return g.select(F.col("window.start").alias("start"), "n", "signals", "mean")


def watch(stream: DataFrame, value: str, center: float, sigma: float, alert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``alert`` with the points out of control of every batch; restarts go on from the checkpoint."""
    flagged = stream.filter(F.abs(F.col(value).cast("double") - center) > 3 * sigma)
    return flagged.writeStream.foreachBatch(alert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
