"""Checks of runs and splits against each other. Each gives rows that say what is wrong; require() makes an error of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Splits and gaps in their order in time.
STAGES = ("train", "gap1", "validation", "gap2", "test")


def require(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raises with the first violations, if there are any."""
    found = violations.limit(show).collect()
    if found:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in found))


def misaligned(a: DataFrame, b: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Keys at which two tables of predictions can't be compared: only one has the row, or their targets differ. Keys must be
    unique in each; a null target equals a null target."""
    left = a.select(*keys, F.col(target).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(*keys, F.col(target).alias("_b"), F.lit(True).alias("_in_b"))
    reason = F.when(F.col("_in_a").isNull(), "only_second").when(F.col("_in_b").isNull(), "only_first").when(~F.col("_a").eqNullSafe(F.col("_b")), "target")
    return left.join(right, keys, "full").withColumn("reason", reason).filter("reason is not null").select(*keys, "reason")


def _not_finite(c: str) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def paired_violations(d: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Per group: rows, rows that lack a target or forecast, rows with a NaN or an infinity. A metric asks for none of either."""
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(y).isNull() | F.col(p).isNull()).alias("n_null"), F.count_if(_not_finite(y) | _not_finite(p)).alias("n_not_finite"))


def parity(a: DataFrame, b: DataFrame, on: list[str], keys: list[str], value: str, rtol: float = 1e-6, atol: float = 1e-8, exact: bool = False) -> DataFrame:
    """Per group how far two models' values for the same rows are apart. b is the one measured against; a label is compared
    exactly. Only rows that both have count; misaligned() finds the others."""
    left, right = a.select(*on, F.col(value).alias("_a")), b.select(*on, F.col(value).alias("_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    differ = ~F.col("_a").eqNullSafe(F.col("_b")) if exact else gap > atol + rtol * F.abs("_b")
    return left.join(right, on).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(differ).alias("n_differ"), F.max(gap).alias("largest")).withColumn("same", F.col("n_differ") == 0)


def split_contract(d: DataFrame, gap: int = 5) -> DataFrame:
    """Per symbol and split or gap: rows, whether they are contiguous, follow right upon the stage before, begin later than it
    ends, and whether a gap has its length."""
    place = reduce(lambda c, s: c.when(F.col("split") == s, STAGES.index(s)), STAGES[1:], F.when(F.col("split") == STAGES[0], 0))
    bounds = d.filter(F.col("split").isNotNull()).groupBy("symbol", "split").agg(F.count("*").alias("n_rows"), F.min("row").alias("_lo"), F.max("row").alias("_hi"), F.min("date").alias("_from"), F.max("date").alias("_to"))
    w = Window.partitionBy("symbol").orderBy(place)  # five rows a symbol
    before = bounds.withColumns({"_before": F.lag("_hi").over(w), "_ended": F.lag("_to").over(w)})
    return before.select(
        "symbol", "split", "n_rows", (F.col("_hi") - F.col("_lo") + 1 == F.col("n_rows")).alias("contiguous"), F.coalesce(F.col("_lo") == F.col("_before") + 1, F.col("_lo") == 0).alias("follows"),
        F.coalesce(F.col("_from") > F.col("_ended"), F.lit(True)).alias("later"), (~F.col("split").startswith("gap") | (F.col("n_rows") == gap)).alias("gap_ok"),
    )


def require_columns_exactly(d: DataFrame, columns: list[str]) -> DataFrame:
    if d.columns != list(columns):
        raise ValueError(f"columns {d.columns}, expected {list(columns)}")
    return d


def fold_spread(folds: DataFrame, pooled: DataFrame, keys: list[str], value: str, numbers: list[int]) -> DataFrame:
    """One row a group: each fold's value, the pooled one, and the distance of the best fold from the worst."""
    wide = folds.groupBy(*keys).pivot("fold", numbers).agg(F.max(value))
    wide = wide.select(*keys, *[F.col(str(n)).alias(f"fold_{n}") for n in numbers])
    each = [F.col(f"fold_{n}") for n in numbers]
    return pooled.select(*keys, F.col(value).alias("pooled")).join(wide, keys, "left").select(*keys, *each, "pooled", (F.greatest(*each) - F.least(*each)).alias("spread"))
