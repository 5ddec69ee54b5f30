"""Chronological splits with purge gaps, thresholds fitted on the first split, labels and fold plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.features import W
from tidemark.schema import FEATURES, LABEL, TARGET

SPLITS = ("train", "validation", "test")


def check_parameters(train: float, validation: float, test: float, gap: int) -> None:
    if not all(isinstance(x, float) and 0 < x < 1 for x in (train, validation, test)) or not math.isclose(train + validation + test, 1):
        raise ValueError("shares must lie in (0, 1) and add up to 1")
    if isinstance(gap, bool) or not isinstance(gap, int) or gap < 0:
        raise ValueError("the gap must be a whole number of rows")


def missing_counts(d: DataFrame, columns: tuple[str, ...] = (*FEATURES, TARGET)) -> DataFrame:
    """Per symbol and column: nulls or NaN, and both infinities."""
    long = d.unpivot(["symbol"], list(columns), "feature", "x")
    return long.groupBy("symbol", "feature").agg(F.count_if(F.col("x").isNull() | F.isnan("x")).alias("n_missing"), F.count_if(F.col("x") == float("inf")).alias("n_plus_inf"), F.count_if(F.col("x") == float("-inf")).alias("n_minus_inf"))


def modeling_rows(d: DataFrame, columns: tuple[str, ...] = (*FEATURES, TARGET)) -> DataFrame:
    """Rows in which all columns are finite; other columns don't matter."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)
    return d.filter(ok)


def chronological_split(d: DataFrame, train: float = 0.70, validation: float = 0.15, test: float = 0.15, gap: int = 5) -> DataFrame:
    """Adds row (place among the symbol's rows) and split: train, gap1, validation, gap2, test. A symbol too short for one
    row in each gets null."""
    check_parameters(train, validation, test, gap)
    whole = Window.partitionBy("symbol")
    d = d.withColumn("row", F.row_number().over(W()) - 1).withColumn("_n", F.count("*").over(whole))
    usable = F.col("_n") - 2 * gap
    n_train, n_val = F.floor(usable * F.lit(train)), F.floor(usable * F.lit(validation))
    r = F.col("row")
    name = F.when((n_train < 1) | (n_val < 1) | (usable - n_train - n_val < 1), F.lit(None)).when(r < n_train, "train").when(r < n_train + gap, "gap1").when(r < n_train + gap + n_val, "validation").when(r < n_train + 2 * gap + n_val, "gap2").otherwise("test")
    return d.withColumn("split", name).drop("_n")


def split_report(d: DataFrame) -> DataFrame:
    return d.groupBy("symbol", "split").agg(F.count("*").alias("n_rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def gap_dates(d: DataFrame) -> DataFrame:
    return d.filter(F.col("split").startswith("gap")).groupBy("symbol", "split").agg(F.sort_array(F.collect_list("date")).alias("dates"))


def threshold(d: DataFrame, q: float = 0.75, target: str = TARGET) -> DataFrame:
    """symbol, threshold: the linear quantile of the training rows' target."""
    return d.filter(F.col("split") == "train").groupBy("symbol").agg(F.percentile(target, q).alias("threshold"))


def with_label(d: DataFrame, fitted: DataFrame, target: str = TARGET, out: str = LABEL) -> DataFrame:
    """1 where the target is over the fitted threshold, strictly. fitted has one row for each symbol."""
    return d.join(fitted, "symbol").withColumn(out, (F.col(target) > F.col("threshold")).cast("int"))


def label_report(d: DataFrame) -> DataFrame:
    return d.filter(F.col("split").isin(*SPLITS)).groupBy("symbol", "split").agg(F.count("*").alias("n_rows"), F.sum(LABEL).alias("n_high"), F.avg(LABEL).alias("share_high"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def target_report(d: DataFrame, target: str = TARGET) -> DataFrame:
    p = F.percentile(target, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    r = d.groupBy("symbol").agg(F.count(target).alias("n"), F.count_if(F.col(target).isNull()).alias("n_null"), F.min(target).alias("min_t"), F.max(target).alias("max_t"), F.avg(target).alias("mean_t"), F.stddev_samp(target).alias("std_t"), p.alias("p"))
    return r.select("symbol", "n", "n_null", "min_t", "max_t", "mean_t", "std_t", *[F.col("p")[i].alias(f"p{k:02d}") for i, k in enumerate((5, 25, 50, 75, 95))])


def split_violations(d: DataFrame) -> DataFrame:
    """Per symbol: whether a split begins before its predecessor ends, dates in two splits, labels that don't follow the
    threshold, targets equal to it."""
    bounds = d.filter(F.col("split").isin(*SPLITS)).groupBy("symbol").agg(
        *[F.min(F.when(F.col("split") == s, F.col("date"))).alias(f"{s}_from") for s in SPLITS], *[F.max(F.when(F.col("split") == s, F.col("date"))).alias(f"{s}_to") for s in SPLITS],
        F.count_if((F.col(TARGET) > F.col("threshold")).cast("int") != F.col(LABEL)).alias("n_label_mismatch"), F.count_if(F.col(TARGET) == F.col("threshold")).alias("n_at_threshold"),
        (F.count("*") - F.countDistinct("date")).alias("n_shared_dates"),
    )
    late = (F.col("train_to") >= F.col("validation_from")).cast("int") + (F.col("validation_to") >= F.col("test_from")).cast("int")
    return bounds.select("symbol", late.cast("long").alias("n_overlaps"), "n_label_mismatch", "n_at_threshold", "n_shared_dates")


def tail_split(d: DataFrame, share: float = 0.15, purge: int = 5, row: str = "row") -> DataFrame:
    """Marks the last share of rows as `tail` and drops the purge rows before it."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    start = n - F.ceil(n * share)
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(row)) - 1
    return d.withColumn("_start", start).withColumn("_place", place).filter((F.col("_place") >= F.col("_start")) | (F.col("_place") < F.col("_start") - purge)).withColumn("tail", F.col("_place") >= F.col("_start")).drop("_start", "_place")


def fold_plan(n: int, folds: int = 4, first: float = 0.5, purge: int = 5) -> list[tuple[int, int, int, int]]:
    """(fold, history end, start, stop): after the first share, nearly equal blocks, each with the history before it less the
    purge rows."""
    begin = int(n * first)
    size, extra = divmod(n - begin, folds)
    out = []
    for k in range(folds):
        stop = begin + size + (k < extra)
        out.append((k, begin - purge, begin, stop))
        begin = stop
    return out


def with_folds(d: DataFrame, folds: int = 4, first: float = 0.5, purge: int = 5, row: str = "row") -> DataFrame:
    """Each row once for every fold in which it is history or block, by the plan of fold_plan() over all rows of its symbol. The
    plan is an array of each row, not a join."""
    d, n = d.withColumn("_n", (F.max(row).over(Window.partitionBy("symbol")) + 1).cast("int")), F.col("_n")
    begin = F.floor(n * first).cast("int")
    size, extra = F.floor((n - begin) / folds).cast("int"), (n - begin) % folds
    starts = [begin + k * size + F.least(F.lit(k), extra) for k in range(folds + 1)]
    spans = F.array(*[F.struct(F.lit(k).alias("fold"), (starts[k] - purge).alias("until"), starts[k].alias("start"), starts[k + 1].alias("stop")) for k in range(folds)])
    x = F.col("f")
    rows = d.withColumn("f", F.explode(spans)).filter((F.col(row) < x["until"]) | F.col(row).between(x["start"], x["stop"] - 1))
    return rows.withColumn("fold", x["fold"]).withColumn("part", F.when(F.col(row) < x["until"], "history").otherwise("block")).drop("f", "_n")


def named_dataset(d: DataFrame, split: str, allow_test: bool = False) -> DataFrame:
    """One split's rows; the test split only on request."""
    if split == "test" and not allow_test:
        raise PermissionError("the test split is closed unless allow_test is set")
    return d.filter(F.col("split") == split)


def positions_on(timeline: DataFrame, subset: DataFrame) -> DataFrame:
    """The subset's rows with their place on the full timeline; a date that isn't on it is an error."""
    placed = timeline.select("symbol", "date", (F.row_number().over(W()) - 1).alias("position"))
    lost = subset.join(placed, ["symbol", "date"], "left_anti")
    if not lost.isEmpty():
        raise ValueError("dates that aren't on the timeline")
    return subset.join(placed, ["symbol", "date"])


def expand_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """All combinations of the parameters, in the order of their sorted names, with a candidate number."""
    from itertools import product

    names = sorted(grid)
    rows = [(i, *c) for i, c in enumerate(product(*[grid[n] for n in names]))]
    return spark.createDataFrame(rows, ["candidate", *names])


def newer_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and those rows of new after each symbol's last old date."""
    last = old.groupBy("symbol").agg(F.max("date").alias("_last"))
    added = new.join(last, "symbol", "left").filter(F.col("_last").isNull() | (F.col("date") > F.col("_last"))).drop("_last")
    return old.unionByName(added, allowMissingColumns=True)
