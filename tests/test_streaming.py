"""The stream gives the rows of the batch."""

from datetime import datetime, timedelta

from tidemark.sources.bars import event_bars
from tidemark.streaming.bars import stream_events, streaming_bars, streaming_wilder


def test_streaming_bars(spark, sf_dir, tmp_path):
    source = str(tmp_path / "events")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(source)
    q = streaming_bars(stream_events(spark, source)).writeStream.outputMode("complete").format("memory").queryName("bars_now").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("bars_now").selectExpr("symbol", "cast(date as timestamp_ntz) date", "open", "close", "high", "low")
    want = event_bars(spark, sf_dir).select("symbol", "date", "open", "close", "high", "low")
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_streaming_wilder(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1) + timedelta(hours=i), float(100 + (i * 7) % 5)) for i in range(30)]
    spark.createDataFrame(rows, "symbol string, date timestamp, close double").coalesce(1).write.parquet(str(tmp_path / "b"))
    s = spark.readStream.schema("symbol string, date timestamp, close double").parquet(str(tmp_path / "b"))
    q = streaming_wilder(s, 14).writeStream.outputMode("append").format("memory").queryName("wilder_now").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.average_gain for r in spark.table("wilder_now").orderBy("date").collect()]
    gains = [max(b[2] - a[2], 0) for a, b in zip(rows, rows[1:])]
    want = [None] * 14 + [sum(gains[:14]) / 14]
    for g in gains[14:]:
        want.append((want[-1] * 13 + g) / 14)
    assert got[:14] == want[:14] and all(abs(a - b) < 1e-12 for a, b in zip(got[14:], want[14:]))
