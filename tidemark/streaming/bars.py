"""Bars from a stream: tumbling windows with a watermark, and the recursive average as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.runtime import ship


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def streaming_bars(events: DataFrame, period: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Bars by symbol and window; a bar is final once the watermark has passed it."""
    key = F.struct("ts", "event_id")
    w = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("symbol"), F.window("ts", period).alias("w"))
    bars = w.agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.sum("value").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")


def streaming_wilder(bars: DataFrame, period: int = 14) -> DataFrame:
    """The recursive average of each symbol's closing gains over bars that arrive in order: state is (last close, bars, average)."""
    ship(bars.sparkSession)

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, average = state.get if state.exists else (float("nan"), 0, 0.0)
        out = []
        for pdf in parts:
            for r in pdf.sort_values("date").itertuples():
                if last == last:
                    gain, n = max(r.close - last, 0.0), n + 1
                    average = average + gain / period if n <= period else (average * (period - 1) + gain) / period
                last = float(r.close)
                out.append((key[0], r.date, average if n >= period else None))
        state.update((last, n, average))
        yield pd.DataFrame(out, columns=["symbol", "date", "average_gain"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, date timestamp, average_gain double", "last double, n long, average double", "append", GroupStateTimeout.NoTimeout)
