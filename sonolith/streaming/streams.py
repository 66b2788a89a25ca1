"""Streaming forms of the gap and window operators, with watermarks for late events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "1.5 seconds", late: str = "10 minutes") -> DataFrame:
    """Spans of activity of each key: events less than the gap apart (or just that) belong together. Works on streams and tables."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, key: str, value: str, time: str = "ts", width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Count, mean and deviation of each key in windows of fixed width."""
    return events.withWatermark(time, late).groupBy(key, F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev")).select(key, F.col("w.start").alias("start"), "n", "mean", "stddev")


def running_ewma(events: DataFrame, key: str, time: str, value: str, weight: float = 0.3) -> DataFrame:
    """A stream's k = 0.7 k + 0.3 x by key, in the order of each batch's times; one row for each event."""
    schema = f"{key} string, {time} timestamp, ewma double"

    def update(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        k = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(time)
        out = []
        for t, x in zip(rows[time], rows[value], strict=True):
            k = float(x) if k is None else k * (1 - weight) + float(x) * weight
            out.append((group[0], t, k))
        state.update((k,))
        yield pd.DataFrame(out, columns=[key, time, "ewma"])

    return events.withColumn(key, F.col(key).cast("string")).groupBy(key).applyInPandasWithState(update, schema, "k double", "append", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Drains a stream into a memory table; for tests and small replays."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
