"""Extreme moves: a fence fitted on the training rows, flags, the rows that a move affects, and audits.

An affected row is one within `back` rows before or `ahead` rows after a move. The join of rows and intervals is one window:
a row is covered by as many moves as there are in the frame from `ahead` rows before it to `back` rows after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import W
from tidemark.operators.splits import SPLITS
from tidemark.schema import LABEL

BACK, AHEAD = 5, 19


def fit_fence(d: DataFrame, multiplier: float = 3.0) -> DataFrame:
    """Per symbol: quartiles of the training rows' absolute return and the fence q3 + multiplier * (q3 - q1)."""
    if not 0 < multiplier < float("inf"):
        raise ValueError("the multiplier must be positive and finite")
    q = d.filter((F.col("split") == "train") & F.col("return_1d").isNotNull()).groupBy("symbol").agg(F.percentile(F.abs("return_1d"), F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q = q.select("symbol", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    return q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("fence", F.col("q3") + multiplier * F.col("iqr"))


def flag(d: DataFrame, fitted: DataFrame) -> DataFrame:
    """is_spike: the absolute return is over the fence, strictly."""
    return d.join(fitted.select("symbol", "fence"), "symbol").withColumn("is_spike", F.coalesce(F.abs("return_1d") > F.col("fence"), F.lit(False)))


def _by_split() -> tuple:
    w = Window.partitionBy("symbol", "split").orderBy("date")
    return w, Window.partitionBy("symbol", "split")


def coverage(d: DataFrame, back: int = BACK, ahead: int = AHEAD) -> DataFrame:
    """coverage: moves that affect each row, and is_spike_affected; nothing reaches over a split's ends."""
    w, _ = _by_split()
    n = F.sum(F.col("is_spike").cast("int")).over(w.rowsBetween(-ahead, back))
    d = d.withColumn("coverage", n).withColumn("is_spike_affected", n > 0)
    segment = F.when(F.col("is_spike"), "direct_spike").when(F.col("is_spike_affected"), "spike_affected").otherwise("unaffected")
    return d.withColumn("diagnostic_segment", segment)


def affected_windows(d: DataFrame, back: int = BACK, ahead: int = AHEAD) -> DataFrame:
    """One row for each move: the interval asked for, the interval within its split, whether it was cut, and its dates."""
    w, whole = _by_split()
    placed = d.withColumn("at", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole))
    spikes = placed.filter("is_spike").select("symbol", "split", "date", "at", (F.col("at") - back).alias("asked_from"), (F.col("at") + ahead).alias("asked_to"), F.greatest(F.lit(0), F.col("at") - back).alias("from_row"), F.least(F.col("n") - 1, F.col("at") + ahead).alias("to_row"))
    dates = placed.select("symbol", "split", "at", "date")
    spikes = spikes.join(dates.select("symbol", "split", F.col("at").alias("from_row"), F.col("date").alias("from_date")), ["symbol", "split", "from_row"])
    spikes = spikes.join(dates.select("symbol", "split", F.col("at").alias("to_row"), F.col("date").alias("to_date")), ["symbol", "split", "to_row"])
    return spikes.withColumn("cut_left", F.col("asked_from") < 0).withColumn("cut_right", F.col("to_row") < F.col("asked_to"))


def affected_summary(covered: DataFrame, windows: DataFrame) -> DataFrame:
    rows = covered.groupBy("symbol", "split").agg(F.count("*").alias("n_rows"), F.count_if("is_spike").alias("n_spikes"), F.count_if("is_spike_affected").alias("n_affected"), F.count_if(F.col("coverage") > 1).alias("n_overlapped"))
    cuts = windows.groupBy("symbol", "split").agg(F.count_if("cut_left").alias("n_cut_left"), F.count_if("cut_right").alias("n_cut_right"))
    return rows.join(cuts, ["symbol", "split"], "left").na.fill(0, ["n_cut_left", "n_cut_right"])


def experiment_datasets(covered: DataFrame) -> DataFrame:
    """Rows by variant: with_spike has all, non_spike lacks the affected training rows; other splits are whole in both."""
    kept = (F.col("split") != "train") | ~F.col("is_spike_affected")
    return covered.filter(F.col("split").isin(*SPLITS)).withColumn("variant", F.explode(F.when(kept, F.array(F.lit("with_spike"), F.lit("non_spike"))).otherwise(F.array(F.lit("with_spike")))))


def class_summary(d: DataFrame, keys: list[str]) -> DataFrame:
    n = d.groupBy(*keys, LABEL).agg(F.count("*").alias("n_rows"))
    return n.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(*keys)))


def outlier_rules(d: DataFrame) -> DataFrame:
    """Per symbol and rule: limit, flagged and affected training rows. Rules: fences of several multipliers, 99th percentile,
    three standard deviations, robust z over 3.5 (median and median absolute deviation)."""
    train = d.filter((F.col("split") == "train") & F.col("return_1d").isNotNull()).withColumn("a", F.abs("return_1d"))
    base = train.groupBy("symbol").agg(F.percentile("a", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.99)])).alias("q"), F.avg("return_1d").alias("mean"), F.stddev_samp("return_1d").alias("sd"))
    mad = train.join(base, "symbol").groupBy("symbol").agg(F.percentile(F.abs(F.col("a") - F.col("q")[1]), 0.5).alias("mad"))
    q = F.col("q")
    limits = F.array(*[F.struct(F.lit(f"iqr_{m}").alias("rule"), (q[2] + m * (q[2] - q[0])).alias("limit")) for m in (1.5, 2.0, 3.0, 4.0)], F.struct(F.lit("p99").alias("rule"), q[3].alias("limit")), F.struct(F.lit("sd_3").alias("rule"), (3 * F.col("sd")).alias("limit")), F.struct(F.lit("robust_z").alias("rule"), (q[1] + 3.5 * F.col("mad") / 0.6745).alias("limit")))
    rules = base.join(mad, "symbol").select("symbol", "mean", F.explode(limits).alias("r")).select("symbol", "mean", "r.*")
    x = F.when(F.col("rule") == "sd_3", F.abs(F.col("return_1d") - F.col("mean"))).otherwise(F.col("a"))
    marked = train.join(rules, "symbol").withColumn("hit", x > F.col("limit"))
    w = Window.partitionBy("symbol", "rule").orderBy("date").rowsBetween(-AHEAD, BACK)
    marked = marked.withColumn("affected", F.sum(F.col("hit").cast("int")).over(w) > 0)
    return marked.groupBy("symbol", "rule").agg(F.first("limit").alias("limit"), F.count_if("hit").alias("n_flagged"), F.count_if(~F.col("affected")).alias("n_retained"))


def _match(a: Column, b: Column, atol: float = 1e-12) -> Column:
    return F.coalesce(F.abs(a - b) <= atol, F.lit(False))


def trace_events(events: DataFrame, stages: dict[str, DataFrame], raw: DataFrame) -> DataFrame:
    """Each move looked up in every stage's table: how often it is there, whether its return follows from the raw closes, and
    a verdict: suspected_data_error, needs_review or market_movement."""
    out = events.select("symbol", "split", "date", "return_1d")
    for name, table in stages.items():
        out = out.join(table.groupBy("symbol", "date").agg(F.count("*").alias(f"n_{name}"), F.first("close").alias(f"close_{name}")), ["symbol", "date"], "left").na.fill(0, [f"n_{name}"])
    before = raw.select("symbol", "date", F.col("close").alias("raw_close"), F.lag("close").over(W()).alias("raw_before"))
    out = out.join(before, ["symbol", "date"], "left").withColumn("raw_return", F.try_divide("raw_close", "raw_before") - 1)
    counts, same = [F.col(f"n_{s}") for s in stages], [F.col(f"n_{s}") == 0 for s in stages]
    twice = F.greatest(*counts) > 1 if len(counts) > 1 else counts[0] > 1
    differs = F.lit(False)
    for s in stages:
        differs = differs | ((F.col(f"n_{s}") > 0) & ~_match(F.col(f"close_{s}"), F.col("raw_close")))
    lost = same[0]
    for s in same[1:]:
        lost = lost | s
    wrong = ~_match(F.col("return_1d"), F.col("raw_return"))
    return out.withColumn("status", F.when(twice | differs | wrong, "suspected_data_error").when(lost, "needs_review").otherwise("market_movement"))
