"""A stateful monitor: each series' limits grow with it, and each new signal is told once.

The state of a series is seven numbers, whatever its length: count, sum, sum of
moving ranges, last value, side and length of the run, and whether it began. A
point is judged by the limits of all points up to itself, so neither the cut
into batches nor a restart from the checkpoint changes what is told.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from qualispark.operators.control import D2_PAIR
from qualispark.sources.scratch import scratch_path

RUN = 9
_STATE = "n long, total double, ranges double, last double, side int, run int"


def judged(values: list[float], state: tuple) -> tuple[list[tuple[int, str, float, float, float]], tuple]:
    """Signals (place, rule, center, lcl, ucl) of new values of a series, and its state after them.

    ``beyond_3sigma`` needs two points; ``run_of_9`` is told at the ninth point
    in a row on one side of the center as it stood at each of them.
    """
    n, total, ranges, last, side, run = state
    out = []
    for i, x in enumerate(values):
        ranges += abs(x - last) if n else 0.0
        n, total, last = n + 1, total + x, x
        center = total / n
        sigma = ranges / (n - 1) / D2_PAIR if n > 1 else 0.0
        low, high = center - 3 * sigma, center + 3 * sigma
        if n > 1 and (x > high or x < low):
            out.append((i, "beyond_3sigma", center, low, high))
        now = (x > center) - (x < center)
        run = run + 1 if now and now == side else abs(now)
        side = now
        if run == RUN:
            out.append((i, "run_of_9", center, low, high))
    return out, (n, total, ranges, last, side, run)


def signals(stream: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, the order columns, value, rule, center, lcl, ucl of every signal of a stream of points.

    Points of a batch are taken in order within their series; rows without a
    key, value or order are left out.
    """
    own = stream.select(key, *order, F.col(value).cast("double").alias("value")).na.drop()
    kinds = dict(own.dtypes)
    names = [key, *order]

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        found, now = judged(rows.value.tolist(), state.get if state.exists else (0, 0.0, 0.0, 0.0, 0, 0))
        state.update(now)
        at = [f[0] for f in found]
        told = {c: rows[c].iloc[at].tolist() for c in (*names, "value")}
        for j, c in enumerate(("rule", "center", "lcl", "ucl"), 1):
            told[c] = [f[j] for f in found]
        yield pd.DataFrame(told)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", value double, rule string, center double, lcl double, ucl double"
    return own.groupBy(key).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def drained(told: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream of signals over all that has arrived, append them to ``path`` and read that table."""
    query = told.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return told.sparkSession.read.schema(told.schema).parquet(path)


def signals_of_files(spark: SparkSession, files: str, key: str, order: list[str], value: str) -> DataFrame:
    """The signals of Parquet files that arrive under ``files``, by a stream that ends when they are read."""
    schema = spark.read.parquet(files).schema
    # as a pattern, so that the path may be one file as well as a folder
    told = signals(spark.readStream.schema(schema).parquet(f"{files[:-1]}[{files[-1]}]"), key, order, value)
    return drained(told, scratch_path(spark, "signals"), scratch_path(spark, "checkpoint"))
