"""Structured Streaming over events: windowed measures per series, late rows dropped by a watermark, and a stateful line length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files of events in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, user_id, n, total, least, greatest per window (tumbling, or sliding with slide); rows later than the watermark are left out."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(window.alias("w"), "user_id")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest")).select(F.col("w.start").alias("start"), "user_id", "n", "total", "least", "greatest")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, user_id, n of runs of a user's events without a longer gap."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def line_lengths(events: DataFrame) -> DataFrame:
    """user_id, n, length: of the line through a user's values by seconds, carried on from batch to batch in order of arrival."""

    def extend(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, length, x0, y0 = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            for t, y in zip(frame["ts"], frame["value"], strict=True):
                x = t.timestamp()
                length += ((x - x0) ** 2 + (y - y0) ** 2) ** 0.5 if n else 0.0
                n, x0, y0 = n + 1, x, y
        state.update((n, length, x0, y0))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "length": [length]})

    return events.groupBy("user_id").applyInPandasWithState(extend, "user_id long, n long, length double", "n long, length double, x double, y double", "update", "NoTimeout")
