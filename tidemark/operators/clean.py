"""Cleaning of bars: coercion, duplicates, impossible values, each counted after the step before it.

clean() is one window over a bar's key and one filter; the counts come from the same marked rows in a single pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import any_date, number
from tidemark.schema import PRICES

VALUES = (*PRICES, "volume")
#: The rules in the order in which they are applied; a row belongs to the first that it fails.
RULES = ("invalid_date", "exact_duplicate", "duplicate_date", "missing_value", "nonpositive_price", "impossible_range", "negative_volume")


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def mark_rows(raw: DataFrame) -> DataFrame:
    """Rows of text columns with values coerced and `rule`, the first rule the row fails (null: it is kept)."""
    typed = raw.select("symbol", any_date(F.col("date")).alias("date"), *[number(F.col(c)).alias(c) for c in VALUES], *[(F.col(c).isNotNull() & number(F.col(c)).isNull()).alias(f"bad_{c}") for c in VALUES])
    content = F.struct(*[F.col(c) for c in VALUES])
    same = Window.partitionBy("symbol", "date").orderBy(*VALUES)
    key = Window.partitionBy("symbol", "date")
    marked = typed.withColumn("copy", F.row_number().over(Window.partitionBy("symbol", "date", *VALUES).orderBy(F.lit(1)))).withColumn("nth", F.row_number().over(same)).withColumn("n_values", F.size(F.collect_set(F.to_json(content, {"ignoreNullFields": "false"})).over(key)))
    rule = (
        F.when(F.col("date").isNull(), "invalid_date")
        .when(F.col("copy") > 1, "exact_duplicate")
        .when(F.col("n_values") > 1, "duplicate_date")
        .when(_any([F.col(c).isNull() for c in VALUES]), "missing_value")
        .when(F.least(*PRICES) <= 0, "nonpositive_price")
        .when((F.col("high") < F.col("low")) | (F.col("open") > F.col("high")) | (F.col("open") < F.col("low")), "impossible_range")
        .when(F.col("volume") < 0, "negative_volume")
    )
    return marked.withColumn("rule", rule).drop("copy", "nth", "n_values")


def conflicts(marked: DataFrame) -> DataFrame:
    """Keys with several different bars; a caller that must not go on raises if there are any."""
    return marked.filter(F.col("rule") == "duplicate_date").select("symbol", "date").distinct()


def clean(raw: DataFrame, fail_on_conflict: bool = True) -> DataFrame:
    """The bars that fail no rule. Different bars of one date are an error, or all dropped if fail_on_conflict is unset."""
    marked = mark_rows(raw)
    if fail_on_conflict:
        found = [f"{r.symbol} {r.date}" for r in conflicts(marked).orderBy("symbol", "date").limit(5).collect()]
        if found:
            raise ValueError(f"conflicting bars: {', '.join(found)}")
    return marked.filter("rule is null").select("symbol", "date", *VALUES)


def cleaning_report(marked: DataFrame) -> DataFrame:
    """Per symbol: rows before and after, rows by rule, cells that weren't numbers, zero volumes kept, first and last date."""
    kept = F.col("rule").isNull()
    return marked.groupBy("symbol").agg(
        F.count("*").alias("rows_before"), F.count_if(kept).alias("rows_after"), *[F.count_if(F.col("rule") == r).alias(r) for r in RULES],
        *[F.count_if(F.col(f"bad_{c}")).alias(f"nonnumeric_{c}") for c in VALUES], F.count_if(kept & (F.col("volume") == 0)).alias("zero_volume"),
        F.min(F.when(kept, F.col("date"))).alias("first_date"), F.max(F.when(kept, F.col("date"))).alias("last_date"),
    )


def contract_violations(bars: DataFrame) -> DataFrame:
    """Per symbol: nulls, unsorted or repeated dates, and bars that can't be."""
    repeated = F.count("*") - F.countDistinct("date")
    bad = (F.least(*PRICES) <= 0) | (F.col("high") < F.col("low")) | ~F.col("open").between(F.col("low"), F.col("high")) | (F.col("volume") < 0)
    return bars.groupBy("symbol").agg(F.count_if(_any([F.col(c).isNull() for c in ("date", *VALUES)])).alias("n_null"), repeated.alias("n_repeated"), F.count_if(bad).alias("n_impossible"))
