"""Bars built from event and transaction tables, and bar tables read from files.

A builder is one aggregation: partial bars are made before the shuffle, so a task sends one row for each symbol and period
it has seen. First and last prices are taken by a key that is unique within the period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import any_date, number
from tidemark.runtime import read_table
from tidemark.schema import BAR, PRICES


def build_bars(rows: DataFrame, symbol: Column, period: Column, price: Column, volume: Column, order: list[str]) -> DataFrame:
    key = F.struct(*order)
    return (
        rows.select(symbol.alias("symbol"), period.alias("date"), price.cast("double").alias("p"), volume.cast("double").alias("v"), key.alias("k"))
        .filter("p is not null and date is not null")
        .groupBy("symbol", "date")
        .agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("v").alias("volume"))
        .select(*BAR)
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of `events.value` by event type."""
    return build_bars(read_table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"), F.col("value"), F.col("value"), ["ts", "event_id"])


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the unit price of `lineitem`."""
    t = read_table(spark, sf_dir, "lineitem")
    return build_bars(t, F.lit("lineitem"), F.col("l_shipdate").cast("date"), F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")), F.col("l_quantity"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of `orders.o_totalprice` by priority."""
    t = read_table(spark, sf_dir, "orders")
    return build_bars(t, F.col("o_orderpriority"), F.col("o_orderdate").cast("date"), F.col("o_totalprice"), F.lit(1.0), ["o_orderkey"])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = BAR[1:]) -> DataFrame:
    """A CSV file with header, every column as text; fails if it has no rows or lacks a column."""
    df = require_columns(spark.read.csv(path, header=True), list(required))
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; a malformed row or a NaN fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)


def normalize_rows(raw: DataFrame) -> DataFrame:
    """Bars from text columns with currency signs, thousands separators and either date format."""
    from tidemark.functions.scalar import plain_number

    return raw.select(any_date(F.col("date")).alias("date"), *[plain_number(F.col(c)).alias(c) for c in (*PRICES, "volume")])


def coerce(raw: DataFrame) -> DataFrame:
    """Bars from text columns; what can't be read is null."""
    return raw.select("symbol", any_date(F.col("date")).alias("date"), *[number(F.col(c)).alias(c) for c in (*PRICES, "volume")])


def profile(raw: DataFrame, columns: tuple[str, ...] = (*PRICES, "volume")) -> DataFrame:
    """One row: rows, first and last date, repeated dates, missing cells and an order-insensitive checksum."""
    missing = sum((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("long") for c in columns)
    return raw.agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        (F.count("date") - F.countDistinct("symbol", "date")).alias("n_repeated_dates"), F.coalesce(F.sum(missing), F.lit(0)).alias("n_missing_cells"),
        F.sum(F.xxhash64(*raw.columns).cast("decimal(38,0)")).alias("checksum"),
    )


def same_profile(now: DataFrame, pinned: DataFrame) -> bool:
    """Whether two profiles, one row each, are equal."""
    return now.exceptAll(pinned.select(*now.columns)).isEmpty()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_table(df: DataFrame, path: str, overwrite: bool = False, format: str = "parquet") -> None:
    """A whole table or none; an existing one stays unless overwrite is set."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("dateFormat", "yyyy-MM-dd")
    writer.option("header", True).format(format).save(path)


def differing_rows(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """Keys at which two tables differ: a row is missing, or a value beyond the tolerance. Nulls equal each other."""
    left, right = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("in_a")), b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("in_b"))
    same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        near = x.eqNullSafe(y) if a.schema[c].dataType.typeName() not in ("double", "float") else x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))
        same = same & near
    return left.join(right, keys, "full").filter(~same).select(*keys)


def payload_rows(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Bars from JSON payloads {"status": {"rCode": 200}, "data": {"rows": [{date, open, ...}]}}: payloads of another status
    or that aren't such JSON give none."""
    row = "struct<date:string,open:string,high:string,low:string,close:string,volume:string>"
    parsed = payload.select(F.from_json(column, f"struct<status:struct<rCode:int>,data:struct<rows:array<{row}>>>").alias("j"))
    return normalize_rows(parsed.filter(F.col("j.status.rCode") == 200).select(F.inline("j.data.rows")))


def row_violations(rows: DataFrame) -> DataFrame:
    """One row: repeated dates, neighbours that aren't in falling order (by `place`), blank cells."""
    from pyspark.sql import Window

    cells = ("date", *PRICES, "volume")
    d = rows.withColumn("_before", F.lag("date").over(Window.partitionBy("symbol").orderBy("place")))
    blank = sum((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("long") for c in cells)
    return d.groupBy("symbol").agg((F.count("date") - F.countDistinct("date")).alias("n_repeated"), F.count_if(F.col("date") >= F.col("_before")).alias("n_out_of_order"), F.sum(blank).alias("n_blank"))


def years_before(date: Column, years: int) -> Column:
    """The same day some years earlier; 29 February becomes the 28th."""
    return F.add_months(date, -12 * years)
