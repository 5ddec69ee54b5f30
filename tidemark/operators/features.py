"""Causal rolling features of bars, the forward target, and what is made of them.

All windows of a symbol share one partitioning and order, so Spark sorts the bars once. Bars are aggregates: their number
per symbol is that of periods, whatever the raw tables hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite, ratio
from tidemark.schema import FEATURES, PERIODS, TARGET

#: Rows after which the recursive average starts a new block of its cumulative sum, far below overflow.
BLOCK = 2048


def W():  # noqa: N802
    """A symbol's rows in the order of time."""
    return Window.partitionBy("symbol").orderBy("date")


def full(x: Column, n: int, value: Column, ahead: bool = False) -> Column:
    """value where x has n values in its frame."""
    frame = W().rowsBetween(1, n) if ahead else W().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, value)


def with_position(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pos", F.row_number().over(W()) - 1)


def simple_return(k: int, price: str = "close") -> Column:
    return ratio(F.col(price), F.lag(price, k).over(W())) - 1


def rolling_volatility(x: str, n: int, periods: int = PERIODS) -> Column:
    return full(F.col(x), n, F.stddev_samp(x).over(W().rowsBetween(1 - n, 0))) * math.sqrt(periods)


def rolling_mean(x: str, n: int) -> Column:
    return full(F.col(x), n, F.avg(x).over(W().rowsBetween(1 - n, 0)))


def wilder(df: DataFrame, x: str, out: str, period: int) -> DataFrame:
    """The recursive average y_p = mean(x_1..x_p), y_i = ((p - 1) y_(i-1) + x_i) / p, without recursion.

    With a = (p - 1) / p it is a sum of x_j a^(i-j) / p, taken within blocks of BLOCK rows by one cumulative sum; of earlier
    blocks only the last one counts, as a^BLOCK is below any double's precision. df has `pos`."""
    a = (period - 1) / period
    block, off = F.floor(F.col("pos") / BLOCK), F.col("pos") % BLOCK
    first = F.sum(x).over(W().rowsBetween(1 - period, 0))
    term = F.when(F.col("pos") < period, F.lit(0.0)).when(F.col("pos") == period, first).otherwise(F.col(x))
    d = df.withColumn("_block", block).withColumn("_term", term * F.pow(F.lit(a), -off) / period)
    inner = Window.partitionBy("symbol", "_block").orderBy("date")
    d = d.withColumn("_part", F.sum("_term").over(inner.rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(a), off))
    d = d.withColumn("_before", F.coalesce(F.lag("_part").over(W()), F.lit(0.0)))
    carry = F.first("_before").over(inner.rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(a), off + 1)
    return d.withColumn(out, F.when(F.col("pos") >= period, F.col("_part") + carry)).drop("_block", "_term", "_part", "_before")


def relative_strength(df: DataFrame, period: int = 14, price: str = "close", out: str = "rsi_14") -> DataFrame:
    change = F.col(price) - F.lag(price).over(W())
    d = df.withColumn("_gain", F.greatest(change, F.lit(0.0))).withColumn("_loss", F.greatest(-change, F.lit(0.0)))
    d = wilder(wilder(d, "_gain", "_g", period), "_loss", "_l", period)
    g, l_ = F.col("_g"), F.col("_l")
    value = F.when((l_ == 0) & (g == 0), F.lit(50.0)).when(l_ == 0, F.lit(100.0)).when(g == 0, F.lit(0.0)).otherwise(100 - 100 / (1 + ratio(g, l_)))
    return d.withColumn(out, F.when(g.isNotNull() & l_.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)))).drop("_gain", "_loss", "_g", "_l")


def zscore(x: str, n: int) -> Column:
    frame = W().rowsBetween(1 - n, 0)
    return full(F.col(x), n, ratio(F.col(x) - F.avg(x).over(frame), F.stddev_samp(x).over(frame)))


def add_features(bars: DataFrame) -> DataFrame:
    """The eight features; infinite values become null."""
    d = with_position(bars).withColumn("return_1d", simple_return(1)).withColumn("return_5d", simple_return(5))
    d = d.withColumns({
        "volatility_5d": rolling_volatility("return_1d", 5), "volatility_20d": rolling_volatility("return_1d", 20),
        "intraday_range": ratio(F.col("high") - F.col("low"), F.col("close")), "sma_ratio_5_20": ratio(rolling_mean("close", 5), rolling_mean("close", 20)),
        "volume_zscore_20": zscore("volume", 20),
    })
    d = relative_strength(d)
    return d.select("symbol", "date", "pos", "open", "high", "low", "close", "volume", *[finite(F.col(c)).alias(c) for c in FEATURES])


def add_target(features: DataFrame, horizon: int = 5, periods: int = PERIODS, out: str = TARGET) -> DataFrame:
    """Volatility of the next `horizon` returns; null where they don't all exist. `label_end_date`: the last one's date."""
    value = full(F.col("return_1d"), horizon, F.stddev_samp("return_1d").over(W().rowsBetween(1, horizon)), ahead=True) * math.sqrt(periods)
    return features.withColumn(out, value).withColumn("label_end_date", F.lead("date", horizon).over(W()))


def return_mismatches(features: DataFrame, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """Rows whose stored return_1d isn't that of their closes."""
    d = features.withColumn("_again", simple_return(1))
    near = F.coalesce(F.abs(F.col("return_1d") - F.col("_again")) <= atol + rtol * F.abs("_again"), F.lit(False))
    return d.filter(~(near | (F.col("return_1d").isNull() & F.col("_again").isNull()))).select("symbol", "date", "pos", "return_1d", F.col("_again").alias("recomputed"))


def feature_report(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Per symbol and feature: rows, nulls, first date with a value, minimum and maximum."""
    long = features.unpivot(["symbol", "date"], list(columns), "feature", "x")
    return long.groupBy("symbol", "feature").agg(F.count("*").alias("n_rows"), F.count_if(F.col("x").isNull()).alias("n_null"), F.min(F.when(F.col("x").isNotNull(), F.col("date"))).alias("first_valid"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))


def har_features(d: DataFrame, floor: float = 0.01, periods: int = PERIODS) -> DataFrame:
    """Logarithmic features d, w, m, r and lev; null where a logarithm doesn't exist."""
    log = lambda c: F.when(F.col(c) > 0, F.log(c))
    return d.withColumns({
        "har_d": F.log(F.greatest(F.abs("return_1d") * math.sqrt(periods), F.lit(floor))), "har_w": log("volatility_5d"), "har_m": log("volatility_20d"),
        "har_r": log("intraday_range"), "har_lev": F.least(F.col("return_5d"), F.lit(0.0)),
    })


def split_suspects(d: DataFrame, limit: float = 0.25) -> DataFrame:
    """Per symbol: moves so large that a price split is likelier."""
    return d.groupBy("symbol").agg(F.count_if(F.abs("return_1d") > limit).alias("n_suspect"))


def lookback_windows(d: DataFrame, length: int, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """symbol, date, window: the `length` complete rows up to each date; dates without a full history are left out."""
    complete = d.na.drop("any", subset=list(columns))
    rows = F.collect_list(F.array(*[F.col(c) for c in columns])).over(W().rowsBetween(1 - length, 0))
    return complete.select("symbol", "date", rows.alias("window")).filter(F.size("window") == length)


def event_windows(d: DataFrame, events: DataFrame, before: int = 10, after: int = 25) -> DataFrame:
    """Rows around each event, by offset: each event names the positions it wants, which meet the rows in an equi-join."""
    wanted = events.select("symbol", F.col("pos").alias("event_pos"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("pos", F.col("event_pos") + F.col("offset"))
    return wanted.join(d, ["symbol", "pos"])
