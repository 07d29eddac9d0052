"""Event streams: windows over late data, and speaking rates kept as state. An extension; batch and stream agree."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream over Parquet files of events that appear in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``window_start, event_type, n, total`` of tumbling windows; rows later than ``late`` are dropped by a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def running_rates(renders: DataFrame) -> DataFrame:
    """``book_id, renders, mean_rate`` kept for each book of a stream of ``book_id, chars, seconds``."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        count, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            good = frame[(frame.seconds > 0.05) & (frame.chars >= 40)]
            count += len(good)
            total += float((good.chars / good.seconds).sum())
        state.update((count, total))
        yield pd.DataFrame({"book_id": [key[0]], "renders": [count], "mean_rate": [total / count if count else None]})

    return renders.groupBy("book_id").applyInPandasWithState(update, "book_id long, renders long, mean_rate double", "renders long, total double", "update", "NoTimeout")
