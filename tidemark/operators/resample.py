"""Moving-block bootstrap, paired differences, block permutation and leaderboards.

A replicate is a set of block starts; its rows come from an equi-join of places, so all replicates of all models are one
aggregation. Starts come either from a formula (any engine gives the same) or from a seeded generator on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio

#: Results depend on them.
BLOCK_ROWS, REPLICATES, SEED, COVERAGE = 20, 2000, 20261011, 0.95


def formula_starts(replicate: Column, block: Column, n: Column, rows: int = BLOCK_ROWS) -> Column:
    return (replicate * 7919 + block * 104729) % (n - rows + 1)


def formula_index(sizes: DataFrame, keys: list[str], replicates: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, replicate, place, row: the rows (0..n-1) of each replicate, by a formula. sizes: keys and n."""
    d = sizes.filter(F.col("n") >= rows).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / rows).cast("int") - 1)))
    d = d.withColumn("start", formula_starts(F.col("replicate"), F.col("block"), F.col("n"), rows)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return d.withColumn("place", F.col("block") * rows + F.col("k")).filter(F.col("place") < F.col("n")).select(*keys, "replicate", "place", (F.col("start") + F.col("k")).alias("row"))


def block_indices(n: int, rows: int = BLOCK_ROWS, replicates: int = REPLICATES, seed: int = SEED) -> np.ndarray:
    """(replicates, n) row numbers: moving blocks from one seeded generator, the last block cut to n."""
    if n < rows:
        raise ValueError("fewer rows than a block")
    random, blocks = np.random.RandomState(seed), math.ceil(n / rows)
    starts = random.randint(0, n - rows + 1, size=(replicates, blocks))
    return (starts[:, :, None] + np.arange(rows)).reshape(replicates, -1)[:, :n]


def index_table(spark: SparkSession, indices: np.ndarray) -> DataFrame:
    """replicate, place, row; a few million small rows at most, as the evaluation set is one series' holdout."""
    r, n = indices.shape
    starts = spark.createDataFrame([(i, indices[i].tolist()) for i in range(r)], "replicate int, rows array<int>")
    return starts.select("replicate", F.posexplode("rows").alias("place", "row"))


def replicated(predictions: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction rows, by replicate. predictions has `row`."""
    return index.join(predictions, [*[k for k in keys if k in index.columns], "row"])


def interval(values: DataFrame, keys: list[str], value: str, coverage: float = COVERAGE) -> DataFrame:
    """n, valid, low, high, se of the replicates' values; null bounds unless nine tenths are defined."""
    q = F.percentile(value, F.array(F.lit((1 - coverage) / 2), F.lit((1 + coverage) / 2)))
    r = values.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("valid"), q.alias("q"), F.stddev_samp(value).alias("se"))
    ok = F.col("valid") >= 0.9 * F.col("n")
    return r.select(*keys, "n", "valid", F.when(ok, F.col("q")[0]).alias("low"), F.when(ok, F.col("q")[1]).alias("high"), F.when(ok, F.col("se")).alias("se"))


def difference(a: DataFrame, b: DataFrame, keys: list[str], value: str, coverage: float = COVERAGE) -> DataFrame:
    """Interval of b - a over paired replicates, and whether it excludes zero."""
    pairs = a.select(*keys, "replicate", F.col(value).alias("a")).join(b.select(*keys, "replicate", F.col(value).alias("b")), [*keys, "replicate"]).withColumn("delta", F.col("b") - F.col("a"))
    out = interval(pairs, keys, "delta", coverage)
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def paired_comparison(a: DataFrame, b: DataFrame, keys: list[str], value: str, higher_is_better: bool, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    d = difference(a, b, keys, value)
    first, second = names if higher_is_better else names[::-1]
    return d.withColumn("verdict", F.when(F.col("low") > 0, f"{second} better").when(F.col("high") < 0, f"{first} better").otherwise("inconclusive"))


def leaderboard(points: DataFrame, replicates: DataFrame, keys: list[str], value: str, higher_is_better: bool) -> DataFrame:
    """Models by value with the interval of their gap to the leader. points: keys, model, value; replicates: with replicate."""
    order = F.desc_nulls_last(value) if higher_is_better else F.asc_nulls_last(value)
    w = Window.partitionBy(*keys).orderBy(order, "model")
    placed = points.withColumn("rank", F.row_number().over(w)).withColumn("leader", F.first("model").over(w))
    lead = replicates.select(*keys, F.col("model").alias("leader"), "replicate", F.col(value).alias("_lead"))
    gaps = placed.select(*keys, "model", "leader").join(replicates, [*keys, "model"]).join(lead, [*keys, "leader", "replicate"]).withColumn("gap", F.col(value) - F.col("_lead"))
    out = placed.join(interval(gaps, [*keys, "model"], "gap").drop("n", "valid", "se"), [*keys, "model"], "left")
    return out.withColumn("tied_with_leader", (F.col("model") == F.col("leader")) | ((F.col("low") <= 0) & (F.col("high") >= 0)))


def against_baseline(board: DataFrame, keys: list[str], value: str, higher_is_better: bool, baselines: list[str]) -> DataFrame:
    """Adds the best baseline's value and whether a model beats it."""
    mine = F.when(F.col("model").isin(*baselines), F.col(value))
    best = (F.max if higher_is_better else F.min)(mine).over(Window.partitionBy(*keys))
    return board.withColumn("best_baseline", best).withColumn("beats_baseline", F.col(value) > best if higher_is_better else F.col(value) < best)


def block_permutation(d: DataFrame, keys: list[str], column: str, repeats: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """For each repeat the rows with `column` taken from another block: blocks of nearly equal size in a hashed order."""
    w = Window.partitionBy(*keys).orderBy("row")
    n = F.count("*").over(Window.partitionBy(*keys))
    size = F.ceil(n / rows)
    blocks = d.select(*keys, "row", F.col(column).alias("_x"), F.floor((F.row_number().over(w) - 1) * size / n).cast("long").alias("_b"))
    again = blocks.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    by = Window.partitionBy(*keys, "repeat")
    shuffled = again.withColumn("row_to", F.row_number().over(by.orderBy(F.xxhash64("repeat", "_b"), "_b", "row")) - 1)
    placed = d.withColumn("_place", F.row_number().over(w) - 1)
    return placed.join(shuffled.select(*keys, "repeat", F.col("row_to").alias("_place"), "_x"), [*keys, "_place"]).drop(column, "_place").withColumnRenamed("_x", column)


def permutation_importance(baseline: DataFrame, permuted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and standard deviation over repeats of the score lost. permuted: keys, feature, repeat, value."""
    d = permuted.join(baseline.select(*keys, F.col(value).alias("_base")), keys).withColumn("lost", F.col("_base") - F.col(value))
    return d.groupBy(*keys, "feature").agg(F.avg("lost").alias("importance"), F.stddev_samp("lost").alias("sd"))


def score_ratio(a: Column, b: Column) -> Column:
    return ratio(a, b)
