"""Report queries: description, correlation, calendar tables, margins, pivots, and JSON rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def describe(d: DataFrame, keys: list[str], columns: list[str], shares: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    long = d.unpivot(keys, columns, "feature", "x")
    r = long.groupBy(*keys, "feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean_x"), F.stddev_samp("x").alias("sd_x"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.percentile("x", F.array(*[F.lit(s) for s in shares])).alias("p"))
    return r.select(*keys, "feature", "n", "mean_x", "sd_x", "min_x", "max_x", *[F.col("p")[i].alias(f"p{round(100 * s):02d}") for i, s in enumerate(shares)])


def correlations(d: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pearson's r of each pair, in long form, over rows complete in the columns; one aggregation."""
    pairs = list(combinations(columns, 2))
    r = d.na.drop("any", subset=columns).groupBy(*keys).agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return r.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def quarterly_confusion(d: DataFrame, keys: list[str], y: str = "y", label: str = "label") -> DataFrame:
    a, b = F.col(y) == 1, F.col(label) == 1
    return d.groupBy(*keys, F.year("date").alias("year"), F.quarter("date").alias("quarter")).agg(F.count("*").alias("n"), F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"), F.sum(F.col(y).cast("long")).alias("n_positive"))


def crosstab(d: DataFrame, a: str, b: str) -> DataFrame:
    """Counts with both margins; a margin's name is `All`."""
    r = d.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).cube("a", "b").agg(F.count("*").alias("n"), F.grouping("a").alias("ga"), F.grouping("b").alias("gb"))
    return r.select(F.when(F.col("ga") == 1, "All").otherwise(F.col("a")).alias("a"), F.when(F.col("gb") == 1, "All").otherwise(F.col("b")).alias("b"), "n")


def top_by_group(d: DataFrame, keys: list[str], value: str, name: str, k: int = 3) -> DataFrame:
    """The names of the k largest values of each group, one column for each rank."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), name)
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).groupBy(*keys).pivot("_r", list(range(1, k + 1))).agg(F.first(name)).select(*keys, *[F.col(str(i)).alias(f"top_{i}") for i in range(1, k + 1)])


def pivot_max(d: DataFrame, row: str, column: str, names: list[str], value: str) -> DataFrame:
    return d.groupBy(row).pivot(column, names).agg(F.max(value))


def pivot_counts(d: DataFrame, row: str, column: str, names: list[str]) -> DataFrame:
    return d.groupBy(row).pivot(column, names).agg(F.count(F.lit(1))).na.fill(0)


def yearly_rows(d: DataFrame, keys: list[str], removed: str, label: str) -> DataFrame:
    return d.groupBy(*keys, F.year("date").alias("year")).agg(F.count("*").alias("n_rows"), F.count_if(removed).alias("n_removed"), F.sum(F.col(label).cast("long")).alias("n_positive"))


def dispersion(d: DataFrame, keys: list[str], x: str, outlier: str) -> DataFrame:
    """Standard deviation with and without outliers, and their ratio."""
    r = d.groupBy(*keys).agg(F.stddev_samp(x).alias("sd_all"), F.stddev_samp(F.when(~F.col(outlier), F.col(x))).alias("sd_without"), F.count_if(outlier).alias("n_outliers"))
    return r.withColumn("sd_ratio", F.try_divide("sd_all", "sd_without"))


def as_json(d: DataFrame, keys: list[str]) -> DataFrame:
    """The other columns as one strict JSON object: NaN and infinities are null."""
    other = [c for c in d.columns if c not in keys]
    safe = [(F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.col(c)) if d.schema[c].dataType.typeName() in ("double", "float") else F.col(c)).alias(c) for c in other]
    return d.select(*keys, F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("json"))
