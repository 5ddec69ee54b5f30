"""Scalar expressions that Spark lacks or that must guard against undefined results. All are plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def sigmoid(z: Column) -> Column:
    """Logistic function by the branch that can't overflow."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def plain_number(text: Column) -> Column:
    """A decimal from text with currency sign and thousands separators; null if it isn't one."""
    return F.regexp_replace(F.trim(text), r"[$,]", "").try_cast("decimal(38,10)").cast("double")


def number(text: Column) -> Column:
    """A finite double from text, else null."""
    return finite(text.try_cast("double"))


def any_date(text: Column) -> Column:
    """A date from M/D/YYYY if the text has a slash, else from ISO; null if it can't be read."""
    return F.when(text.contains("/"), F.try_to_timestamp(text, F.lit("M/d/yyyy"))).otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def measured(value: Column, reason: Column) -> Column:
    """A value with the reason why it is undefined: one of both is null."""
    return F.struct(value.alias("value"), F.when(value.isNull(), reason).alias("reason"))
