"""Every query of the package by name, with SQL that gives the same rows where SQL can.

Hourly bars of `events` by type and daily bars of `lineitem` and `orders` stand for the series. tidy() rounds doubles and
widens integers, so that both engines' rows compare equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models import grid, native
from tidemark.operators import checks, clean, features, metrics, reports, resample, spikes, splits
from tidemark.plans import oracle as o
from tidemark.runtime import read_table, ship
from tidemark.schema import FEATURES, LABEL, TARGET
from tidemark.sources import bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
X = list(FEATURES)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def tidy(d: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in d.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, digits) if kind in ("double", "float") else c.cast("long") if kind in ("integer", "short", "byte") else c).alias(f.name))
    return d.select(*out)


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_target(features.add_features(bars.event_bars(spark, sf_dir)))


def event_labels(spark: SparkSession, sf_dir: str, source=bars.event_bars) -> DataFrame:
    d = splits.chronological_split(splits.modeling_rows(features.add_target(features.add_features(source(spark, sf_dir)))))
    return splits.with_label(d, splits.threshold(d))


def lineitem_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_labels(spark, sf_dir, bars.lineitem_bars)


def event_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_labels(spark, sf_dir)
    return spikes.coverage(spikes.flag(d, spikes.fit_fence(d)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persistence forecast as a prediction: y and target against the last five days' volatility."""
    d = event_labels(spark, sf_dir).filter(F.col("split").isin(*splits.SPLITS))
    return d.select("symbol", "split", "date", "row", F.col(TARGET).alias("target"), F.col(LABEL).alias("y"), F.col("volatility_5d").alias("score"), F.col("volatility_5d").alias("prediction"), (F.col("volatility_5d") > F.col("threshold")).cast("int").alias("label"), "volatility_20d", "threshold")


_SCORED = o.labeled("events") + ", scored AS MATERIALIZED (SELECT symbol, split, date, row, target_volatility_5d AS target, target_high_volatility AS y, volatility_5d AS score, volatility_5d AS prediction, (volatility_5d > threshold)::INT AS label, volatility_20d, threshold FROM labeled WHERE split IN ('train', 'validation', 'test'))"
_RANKED = _SCORED + """, groups AS (SELECT symbol, split, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM scored GROUP BY ALL),
ranked AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, sum(pos) OVER (PARTITION BY symbol, split) AS all_pos, sum(neg) OVER (PARTITION BY symbol, split) AS all_neg FROM groups WINDOW w AS (PARTITION BY symbol, split ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
_BAR_COLUMNS = o.rounded("open; high; low; close; volume")
KEYS = ["symbol", "split"]


@query("bars_events", o.bars("events") + f" SELECT symbol, date, {_BAR_COLUMNS} FROM bars")
def bars_events(spark, sf_dir):
    return tidy(bars.event_bars(spark, sf_dir))


# unit prices have seven decimals at most where they end: rounded to eight there are no ties
@query("bars_lineitem", o.bars("lineitem") + f" SELECT symbol, date, {o.rounded('open; high; low; close; volume', 8)} FROM bars")
def bars_lineitem(spark, sf_dir):
    return tidy(bars.lineitem_bars(spark, sf_dir), 8)


@query("bars_orders", o.bars("orders") + f" SELECT symbol, date, {_BAR_COLUMNS} FROM bars")
def bars_orders(spark, sf_dir):
    return tidy(bars.order_bars(spark, sf_dir))


@query("profile_bars", o.bars("orders") + " SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(date) - count(DISTINCT (symbol, date)) AS n_repeated_dates, sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT)::BIGINT AS n_missing_cells FROM bars")
def profile_bars(spark, sf_dir):
    return tidy(bars.profile(bars.order_bars(spark, sf_dir)).drop("checksum"))


_FEATURE_COLUMNS = o.rounded("; ".join(X), 5)


@query("features_events", o.features("events") + f" SELECT symbol, date, pos, {_FEATURE_COLUMNS}, {o.rounded(TARGET, 5)}, label_end_date FROM features")
def features_events(spark, sf_dir):
    return tidy(event_features(spark, sf_dir).select("symbol", "date", "pos", *X, TARGET, "label_end_date"), 5)


@query("features_lineitem", o.features("lineitem") + f" SELECT symbol, date, pos, {_FEATURE_COLUMNS} FROM features")
def features_lineitem(spark, sf_dir):
    return tidy(features.add_features(bars.lineitem_bars(spark, sf_dir)).select("symbol", "date", "pos", *X), 5)


@query("feature_report", o.features("events") + f" SELECT symbol, feature, count(*) AS n_rows, count(*) FILTER (x IS NULL) AS n_null, min(date) FILTER (x IS NOT NULL) AS first_valid, {o.rounded('min_x=min(x); max_x=max(x)', 5)} FROM (SELECT * FROM (SELECT symbol, date, {', '.join(X)} FROM features) UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(X)}))) GROUP BY ALL")
def feature_report(spark, sf_dir):
    return tidy(features.feature_report(event_features(spark, sf_dir)), 5)


@query("missing_counts", o.features("events") + f" SELECT symbol, feature, count(*) FILTER (x IS NULL) AS n_missing, count(*) FILTER (x = 'inf'::DOUBLE) AS n_plus_inf, count(*) FILTER (x = '-inf'::DOUBLE) AS n_minus_inf FROM (SELECT * FROM (SELECT symbol, {', '.join([*X, TARGET])} FROM features) UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join([*X, TARGET])}))) GROUP BY ALL")
def missing_counts(spark, sf_dir):
    return tidy(splits.missing_counts(event_features(spark, sf_dir)))


@query("target_report", o.features("lineitem") + f" SELECT symbol, count(t) AS n, count(*) - count(t) AS n_null, {o.rounded('min_t=min(t); max_t=max(t); mean_t=avg(t); std_t=stddev_samp(t); p05=quantile_cont(t, 0.05); p25=quantile_cont(t, 0.25); p50=quantile_cont(t, 0.5); p75=quantile_cont(t, 0.75); p95=quantile_cont(t, 0.95)')} FROM (SELECT symbol, target_volatility_5d AS t FROM features) GROUP BY symbol")
def target_report(spark, sf_dir):
    return tidy(splits.target_report(features.add_target(features.add_features(bars.lineitem_bars(spark, sf_dir)))))


@query("return_mismatches", o.features("events") + " SELECT symbol, date, pos FROM features WHERE return_1d IS NOT NULL AND return_1d <> 0 AND pos % 50 = 7")
def return_mismatches(spark, sf_dir):
    d = event_features(spark, sf_dir).withColumn("return_1d", F.when(F.col("pos") % 50 == 7, F.col("return_1d") * 1.01).otherwise(F.col("return_1d")))
    return tidy(features.return_mismatches(d).select("symbol", "date", "pos"))


@query("har_features", o.features("lineitem") + f" SELECT symbol, date, {o.rounded('har_d=ln(greatest(abs(return_1d) * sqrt(252), 0.01)); har_w=CASE WHEN volatility_5d > 0 THEN ln(volatility_5d) END; har_m=CASE WHEN volatility_20d > 0 THEN ln(volatility_20d) END; har_r=CASE WHEN intraday_range > 0 THEN ln(intraday_range) END; har_lev=least(return_5d, 0)')} FROM features WHERE pos >= 20")
def har_features(spark, sf_dir):
    d = features.har_features(features.add_features(bars.lineitem_bars(spark, sf_dir))).filter("pos >= 20")
    return tidy(d.select("symbol", "date", "har_d", "har_w", "har_m", "har_r", "har_lev"))


@query("split_suspects", o.features("events") + " SELECT symbol, count(*) FILTER (abs(return_1d) > 0.25) AS n_suspect FROM features GROUP BY symbol")
def split_suspects(spark, sf_dir):
    return features.split_suspects(event_features(spark, sf_dir))


@query("split_report", o.labeled("events") + " SELECT symbol, split, count(*) AS n_rows, min(row) AS first_row, max(row) AS last_row, min(date) AS first_date, max(date) AS last_date FROM labeled GROUP BY ALL")
def split_report(spark, sf_dir):
    return tidy(splits.split_report(event_labels(spark, sf_dir)))


@query("gap_dates", o.labeled("lineitem") + " SELECT symbol, split, string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date) AS dates FROM labeled WHERE split LIKE 'gap%' GROUP BY ALL")
def gap_dates(spark, sf_dir):
    return splits.gap_dates(lineitem_labels(spark, sf_dir)).withColumn("dates", F.array_join(F.transform("dates", lambda x: F.date_format(x, "yyyy-MM-dd")), ","))


@query("label_counts", o.labeled("events") + f" SELECT symbol, split, count(*) AS n_rows, {o.whole('n_high=sum(target_high_volatility)')}, {o.rounded('share_high=avg(target_high_volatility)')}, min(date) AS first_date, max(date) AS last_date FROM labeled WHERE split IN ('train', 'validation', 'test') GROUP BY ALL")
def label_counts(spark, sf_dir):
    return tidy(splits.label_report(event_labels(spark, sf_dir)))


@query("label_threshold", o.labeled("lineitem") + f" SELECT symbol, {o.rounded('threshold')} FROM fitted")
def label_threshold(spark, sf_dir):
    d = splits.chronological_split(splits.modeling_rows(features.add_target(features.add_features(bars.lineitem_bars(spark, sf_dir)))))
    return tidy(splits.threshold(d))


@query("split_violations", o.labeled("events") + """ SELECT symbol, ((max(date) FILTER (split = 'train') >= min(date) FILTER (split = 'validation'))::INT + (max(date) FILTER (split = 'validation') >= min(date) FILTER (split = 'test'))::INT)::BIGINT AS n_overlaps,
  count(*) FILTER ((target_volatility_5d > threshold)::INT <> target_high_volatility) AS n_label_mismatch, count(*) FILTER (target_volatility_5d = threshold) AS n_at_threshold, count(*) - count(DISTINCT date) AS n_shared_dates FROM labeled WHERE split IN ('train', 'validation', 'test') GROUP BY symbol""")
def split_violations(spark, sf_dir):
    return tidy(splits.split_violations(event_labels(spark, sf_dir)))


@query("tail_split", o.labeled("events") + """, t AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY row) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM labeled WHERE split = 'train')
SELECT symbol, p >= n - ceil(n * 0.15::DOUBLE) AS tail, count(*) AS n_rows FROM t WHERE p >= n - ceil(n * 0.15::DOUBLE) OR p < n - ceil(n * 0.15::DOUBLE) - 5 GROUP BY ALL""")
def tail_split(spark, sf_dir):
    return splits.tail_split(event_labels(spark, sf_dir).filter("split = 'train'")).groupBy("symbol", "tail").agg(F.count("*").alias("n_rows"))


@query("fold_rows", o.labeled("events") + """, t AS (SELECT symbol, row FROM labeled WHERE split = 'train'), s AS (SELECT symbol, (max(row) + 1) // 2 AS begin, max(row) + 1 - (max(row) + 1) // 2 AS rest FROM t GROUP BY symbol),
plan AS (SELECT symbol, fold, begin + fold * (rest // 4) + least(fold, rest % 4) AS start, begin + (fold + 1) * (rest // 4) + least(fold + 1, rest % 4) AS stop FROM s, range(4) AS f(fold))
SELECT symbol, fold::BIGINT AS fold, CASE WHEN row < start - 5 THEN 'history' ELSE 'block' END AS part, count(*) AS n_rows FROM t JOIN plan USING (symbol) WHERE row < start - 5 OR row BETWEEN start AND stop - 1 GROUP BY ALL""")
def fold_rows(spark, sf_dir):
    d = splits.with_folds(event_labels(spark, sf_dir).filter("split = 'train'"))
    return tidy(d.groupBy("symbol", "fold", "part").agg(F.count("*").alias("n_rows")))


#: Which rows (numbered by date) have which fault; cells that aren't numbers by column.
BAD_CELLS = {"open": 53, "high": 47, "low": 43, "close": 41, "volume": 61}
FAULTS = (97, 89, 83, 79, 73, 71, *BAD_CELLS.values())
_SOUND = " AND ".join(f"k % {n} <> 0" for n in FAULTS)
_NO_BAD = ", ".join(f"false AS bad_{c}" for c in clean.VALUES)
_DIRTY = f""", raw AS (SELECT symbol, strftime(date, '%Y-%m-%d') AS date, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars),
dirty AS (SELECT symbol, CASE WHEN k % 97 = 0 THEN 'bad' ELSE date END AS date, CASE WHEN k % 53 = 0 THEN NULL WHEN k % 89 = 0 THEN -open ELSE open END AS open, CASE WHEN k % 47 = 0 THEN NULL WHEN k % 83 = 0 THEN low - 1 ELSE high END AS high, CASE WHEN k % 43 <> 0 THEN low END AS low,
  CASE WHEN k % 79 <> 0 AND k % 41 <> 0 THEN close END AS close, CASE WHEN k % 61 = 0 THEN NULL WHEN k % 73 = 0 THEN -1 WHEN k % 71 = 0 THEN 0 ELSE volume END AS volume, {', '.join(f'k % {n} = 0 AS bad_{c}' for c, n in BAD_CELLS.items())} FROM raw
  UNION ALL SELECT symbol, date, open, high, low, close, volume, {_NO_BAD} FROM raw WHERE k % 67 = 0 AND {_SOUND}
  UNION ALL SELECT symbol, date, open, high, low, close, volume + 1, {_NO_BAD} FROM raw WHERE k % 59 = 0 AND k % 67 <> 0 AND {_SOUND}),
variety AS (SELECT symbol, date, count(*) AS n_values FROM (SELECT DISTINCT symbol, date, open, high, low, close, volume FROM dirty) GROUP BY ALL),
marked AS (SELECT *, row_number() OVER (PARTITION BY symbol, date, open, high, low, close, volume) AS copy FROM dirty JOIN variety USING (symbol, date)),
ruled AS (SELECT *, CASE WHEN date = 'bad' THEN 'invalid_date' WHEN copy > 1 THEN 'exact_duplicate' WHEN n_values > 1 THEN 'duplicate_date' WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 'missing_value'
  WHEN least(open, high, low, close) <= 0 THEN 'nonpositive_price' WHEN high < low OR open > high OR open < low THEN 'impossible_range' WHEN volume < 0 THEN 'negative_volume' END AS rule FROM marked)"""


def dirty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of `orders` as text, with faults of every rule at fixed rows."""
    from functools import reduce

    from pyspark.sql import Window

    d = bars.order_bars(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("date"))).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    k = lambda n: F.col("k") % n == 0
    broken = d.withColumns({"date": F.when(k(97), "bad").otherwise(F.col("date")), "open": F.when(k(89), -F.col("open")).otherwise(F.col("open")), "high": F.when(k(83), F.col("low") - 1).otherwise(F.col("high")), "close": F.when(~k(79), F.col("close")), "volume": F.when(k(73), -1.0).when(k(71), 0.0).otherwise(F.col("volume"))})
    text = [F.col(c).cast("string").alias(c) for c in clean.VALUES]
    broken = broken.select("symbol", "date", *[F.when(k(BAD_CELLS[c]), "n/a").otherwise(F.col(c).cast("string")).alias(c) for c in clean.VALUES])
    sound = d.filter(reduce(lambda a, b: a & b, [~k(n) for n in FAULTS]))
    twice = sound.filter(k(67)).select("symbol", "date", *text)
    other = sound.filter(k(59) & ~k(67)).withColumn("volume", F.col("volume") + 1).select("symbol", "date", *text)
    return broken.unionByName(twice).unionByName(other)


@query("clean_rows", o.bars("orders") + _DIRTY + f" SELECT symbol, strptime(date, '%Y-%m-%d')::DATE AS date, {_BAR_COLUMNS} FROM ruled WHERE rule IS NULL")
def clean_rows(spark, sf_dir):
    return tidy(clean.clean(dirty_rows(spark, sf_dir), fail_on_conflict=False))


@query("cleaning_report", o.bars("orders") + _DIRTY + f""" SELECT symbol, count(*) AS rows_before, count(*) FILTER (rule IS NULL) AS rows_after, {', '.join(f"count(*) FILTER (rule = '{r}') AS {r}" for r in clean.RULES)}, {', '.join(f'count(*) FILTER (bad_{c}) AS nonnumeric_{c}' for c in clean.VALUES)},
  count(*) FILTER (rule IS NULL AND volume = 0) AS zero_volume, min(date::DATE) FILTER (rule IS NULL) AS first_date, max(date::DATE) FILTER (rule IS NULL) AS last_date FROM (SELECT * REPLACE (CASE WHEN date <> 'bad' THEN date END AS date) FROM ruled) GROUP BY symbol""")
def cleaning_report(spark, sf_dir):
    return tidy(clean.cleaning_report(clean.mark_rows(dirty_rows(spark, sf_dir))))


@query("contract_violations", o.bars("events") + " SELECT symbol, count(*) FILTER (date IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS n_null, count(*) - count(DISTINCT date) AS n_repeated, count(*) FILTER (least(open, high, low, close) <= 0 OR high < low OR open NOT BETWEEN low AND high OR volume < 0) AS n_impossible FROM bars GROUP BY symbol")
def contract_violations(spark, sf_dir):
    return tidy(clean.contract_violations(bars.event_bars(spark, sf_dir)))


@query("newer_rows", o.bars("orders") + ", last AS (SELECT symbol, max(date) AS last FROM bars WHERE year(date) < 1997 GROUP BY symbol) SELECT symbol, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM (SELECT symbol, date FROM bars WHERE year(date) < 1997 UNION ALL SELECT symbol, date FROM bars LEFT JOIN last USING (symbol) WHERE last IS NULL OR date > last) GROUP BY symbol")
def newer_rows(spark, sf_dir):
    d = bars.order_bars(spark, sf_dir)
    return splits.newer_rows(d.filter(F.year("date") < 1997), d).groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("differing_rows", o.bars("orders") + " SELECT symbol, date FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars) WHERE k % 100 = 0 OR k % 130 = 0")
def differing_rows(spark, sf_dir):
    from pyspark.sql import Window

    d = bars.order_bars(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    other = d.withColumn("close", F.when(F.col("k") % 100 == 0, F.col("close") + 1).otherwise(F.col("close"))).filter("k % 130 <> 0")
    return bars.differing_rows(d, other, ["symbol", "date"], ["open", "close"])


@query("spike_fence", o.spikes("events") + f" SELECT symbol, {o.rounded('q1; q3; iqr=q3 - q1; fence')} FROM fence")
def spike_fence(spark, sf_dir):
    return tidy(spikes.fit_fence(event_labels(spark, sf_dir)))


@query("spike_coverage", o.spikes("events") + " SELECT symbol, split, date, is_spike, coverage, coverage > 0 AS is_spike_affected, CASE WHEN is_spike THEN 'direct_spike' WHEN coverage > 0 THEN 'spike_affected' ELSE 'unaffected' END AS diagnostic_segment FROM covered")
def spike_coverage(spark, sf_dir):
    return tidy(event_spikes(spark, sf_dir).select("symbol", "split", "date", "is_spike", "coverage", "is_spike_affected", "diagnostic_segment"))


_WINDOWS = """, spans AS (SELECT s.symbol, s.split, s.date, s.at, s.at - 5 AS asked_from, s.at + 19 AS asked_to, greatest(0, s.at - 5) AS from_row, least(s.n - 1, s.at + 19) AS to_row FROM flagged s WHERE is_spike),
cuts AS (SELECT p.*, a.date AS from_date, b.date AS to_date, asked_from < 0 AS cut_left, to_row < asked_to AS cut_right FROM spans p JOIN flagged a ON a.symbol = p.symbol AND a.split = p.split AND a.at = from_row JOIN flagged b ON b.symbol = p.symbol AND b.split = p.split AND b.at = to_row)"""


@query("affected_windows", o.spikes("events") + _WINDOWS + " SELECT symbol, split, date, asked_from, asked_to, from_row, to_row, from_date, to_date, cut_left, cut_right FROM cuts")
def affected_windows(spark, sf_dir):
    d = spikes.affected_windows(event_spikes(spark, sf_dir))
    return tidy(d.select("symbol", "split", "date", "asked_from", "asked_to", "from_row", "to_row", "from_date", "to_date", "cut_left", "cut_right"))


@query("affected_summary", o.spikes("events") + _WINDOWS + """, c AS (SELECT symbol, split, count(*) FILTER (cut_left) AS n_cut_left, count(*) FILTER (cut_right) AS n_cut_right FROM cuts GROUP BY ALL)
SELECT symbol, split, n_rows, n_spikes, n_affected, n_overlapped, coalesce(n_cut_left, 0) AS n_cut_left, coalesce(n_cut_right, 0) AS n_cut_right
FROM (SELECT symbol, split, count(*) AS n_rows, count(*) FILTER (is_spike) AS n_spikes, count(*) FILTER (coverage > 0) AS n_affected, count(*) FILTER (coverage > 1) AS n_overlapped FROM covered GROUP BY ALL) LEFT JOIN c USING (symbol, split)""")
def affected_summary(spark, sf_dir):
    d = event_spikes(spark, sf_dir)
    return tidy(spikes.affected_summary(d, spikes.affected_windows(d)))


_VARIANTS = """, variants AS (SELECT *, 'with_spike' AS variant FROM covered WHERE split IN ('train', 'validation', 'test') UNION ALL SELECT *, 'non_spike' FROM covered WHERE split IN ('validation', 'test') OR split = 'train' AND coverage = 0)"""


@query("experiment_datasets", o.spikes("events") + _VARIANTS + f" SELECT variant, symbol, split, count(*) AS n_rows, {o.whole('n_high=sum(target_high_volatility)')}, count(*) FILTER (coverage > 0) AS n_affected FROM variants GROUP BY ALL")
def experiment_datasets(spark, sf_dir):
    d = spikes.experiment_datasets(event_spikes(spark, sf_dir))
    return tidy(d.groupBy("variant", "symbol", "split").agg(F.count("*").alias("n_rows"), F.sum(LABEL).alias("n_high"), F.count_if("is_spike_affected").alias("n_affected")))


@query("class_summary", o.spikes("events") + _VARIANTS + f" SELECT variant, symbol, split, {o.whole('target_high_volatility')}, count(*) AS n_rows, {o.rounded('share=count(*) / sum(count(*)) OVER (PARTITION BY variant, symbol, split)')} FROM variants GROUP BY variant, symbol, split, target_high_volatility")
def class_summary(spark, sf_dir):
    return tidy(spikes.class_summary(spikes.experiment_datasets(event_spikes(spark, sf_dir)), ["variant", "symbol", "split"]))


@query("outlier_rules", o.labeled("events") + f""", t AS (SELECT symbol, date, return_1d AS r, abs(return_1d) AS a FROM labeled WHERE split = 'train'),
b AS (SELECT symbol, quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.5) AS q2, quantile_cont(a, 0.75) AS q3, quantile_cont(a, 0.99) AS p99, avg(r) AS m, stddev_samp(r) AS sd FROM t GROUP BY symbol),
d AS (SELECT symbol, quantile_cont(abs(a - q2), 0.5) AS mad FROM t JOIN b USING (symbol) GROUP BY symbol),
rules AS (SELECT symbol, m, unnest(['iqr_1.5', 'iqr_2.0', 'iqr_3.0', 'iqr_4.0', 'p99', 'sd_3', 'robust_z']) AS rule, unnest([q3 + 1.5 * (q3 - q1), q3 + 2 * (q3 - q1), q3 + 3 * (q3 - q1), q3 + 4 * (q3 - q1), p99, 3 * sd, q2 + 3.5 * mad / 0.6745]) AS lim FROM b JOIN d USING (symbol)),
h AS (SELECT symbol, rule, lim, date, (CASE WHEN rule = 'sd_3' THEN abs(r - m) ELSE a END > lim)::INT AS hit FROM t JOIN rules USING (symbol)),
c AS (SELECT *, sum(hit) OVER (PARTITION BY symbol, rule ORDER BY date ROWS BETWEEN 19 PRECEDING AND 5 FOLLOWING) AS cover FROM h)
SELECT symbol, rule, {o.rounded('limit=any_value(lim)').replace(' AS limit', ' AS "limit"')}, {o.whole('n_flagged=sum(hit)')}, count(*) FILTER (cover = 0) AS n_retained FROM c GROUP BY symbol, rule""")
def outlier_rules(spark, sf_dir):
    return tidy(spikes.outlier_rules(event_labels(spark, sf_dir)))


@query("trace_events", o.spikes("events") + """ SELECT symbol, split, date, 1::BIGINT AS n_raw, 1::BIGINT AS n_features, (row % 2 = 0)::BIGINT AS n_modeled, CASE WHEN row % 2 = 0 THEN 'market_movement' ELSE 'needs_review' END AS status FROM flagged WHERE is_spike""")
def trace_events(spark, sf_dir):
    raw, d = bars.event_bars(spark, sf_dir), event_spikes(spark, sf_dir)
    events = d.filter("is_spike")
    stages = {"raw": raw, "features": features.add_features(raw), "modeled": d.filter("row % 2 = 0")}
    return tidy(spikes.trace_events(events, stages, raw).select("symbol", "split", "date", "n_raw", "n_features", "n_modeled", "status"))


@query("dispersion", o.spikes("events") + f" SELECT symbol, {o.rounded('sd_all=stddev_samp(return_1d); sd_without=stddev_samp(return_1d) FILTER (NOT is_spike); sd_ratio=stddev_samp(return_1d) / nullif(stddev_samp(return_1d) FILTER (NOT is_spike), 0)')}, count(*) FILTER (is_spike) AS n_outliers FROM flagged GROUP BY symbol")
def dispersion(spark, sf_dir):
    return tidy(reports.dispersion(event_spikes(spark, sf_dir), ["symbol"], "return_1d", "is_spike"))


@query("regression_metrics", _SCORED + f" SELECT symbol, split, count(*) AS n, {o.rounded('mae=avg(abs(target - prediction)); mse=avg((target - prediction) ** 2); rmse=sqrt(avg((target - prediction) ** 2)); r2=1 - avg((target - prediction) ** 2) / nullif(var_pop(target), 0)', 5)}, count(*) FILTER (prediction < 0) AS n_negative FROM scored GROUP BY ALL")
def regression_metrics(spark, sf_dir):
    return tidy(metrics.regression_metrics(scored(spark, sf_dir), KEYS, "target"), 5)


_CONFUSION = "SELECT symbol, split, count(*) AS n, count(*) FILTER (y = 1 AND label = 1) AS tp, count(*) FILTER (y <> 1 AND label = 1) AS fp, count(*) FILTER (y = 1 AND label <> 1) AS fn, count(*) FILTER (y <> 1 AND label <> 1) AS tn FROM scored GROUP BY symbol, split"


@query("confusion_metrics", _SCORED + f" SELECT *, {o.rounded('accuracy=(tp + tn) / n; precision=tp / nullif(tp + fp, 0); recall=tp / nullif(tp + fn, 0); specificity=tn / nullif(tn + fp, 0); f1=2 * tp / nullif(2 * tp + fp + fn, 0)')} FROM ({_CONFUSION})")
def confusion_metrics(spark, sf_dir):
    return tidy(metrics.confusion_metrics(scored(spark, sf_dir), KEYS))


@query("rank_metrics", _RANKED + f" SELECT symbol, split, {o.whole('n_pos=max(all_pos); n_neg=max(all_neg)')}, {o.rounded('roc_auc=CASE WHEN max(all_pos) > 0 AND max(all_neg) > 0 THEN sum(neg * (2 * cum_pos - pos)) / (2 * max(all_pos) * max(all_neg)) END; average_precision=CASE WHEN max(all_pos) > 0 AND max(all_neg) > 0 THEN sum(pos * cum_pos / (cum_pos + cum_neg)) / max(all_pos) END')} FROM ranked GROUP BY symbol, split")
def rank_metrics(spark, sf_dir):
    return tidy(metrics.rank_metrics(scored(spark, sf_dir), KEYS))


@query("roc_curve", _RANKED + f" SELECT symbol, split, {o.rounded('score; fpr=cum_neg / nullif(all_neg, 0); tpr=cum_pos / nullif(all_pos, 0)')} FROM ranked")
def roc_curve(spark, sf_dir):
    return tidy(metrics.roc_curve(scored(spark, sf_dir), KEYS))


@query("precision_recall_curve", _RANKED + f" SELECT symbol, split, {o.rounded('score; precision=cum_pos / (cum_pos + cum_neg); recall=cum_pos / nullif(all_pos, 0)')} FROM ranked")
def precision_recall_curve(spark, sf_dir):
    return tidy(metrics.precision_recall_curve(scored(spark, sf_dir), KEYS))


@query("select_threshold", _RANKED + f", f AS (SELECT symbol, split, score, 2 * cum_pos / (cum_pos + cum_neg + all_pos) AS f1, cum_pos / all_pos AS recall FROM ranked WHERE all_pos > 0) SELECT symbol, split, {o.rounded('threshold=score; f1; recall')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY f1 DESC, recall DESC, score) AS k FROM f) WHERE k = 1")
def select_threshold(spark, sf_dir):
    return tidy(metrics.select_threshold(scored(spark, sf_dir), KEYS))


_M = "(2 * y - 1) * z"


@query("losses", _SCORED + f", m AS (SELECT symbol, split, y, score - threshold AS z FROM scored) SELECT symbol, split, {o.rounded(f'bce=avg(-(y * ln(least(greatest(1 / (1 + exp(-z)), 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(1 / (1 + exp(-z)), 1e-15), 1 - 1e-15)))); logistic=avg(greatest(-{_M}, 0) + ln(1 + exp(-abs(z)))); hinge=avg(greatest(0, 1 - {_M})); perceptron=avg(greatest(0, -{_M})); mistakes=avg(({_M} <= 0)::INT)', 4)} FROM m GROUP BY ALL")
def losses(spark, sf_dir):
    from tidemark.functions.scalar import sigmoid

    y, z = F.col("y"), F.col("score") - F.col("threshold")
    d = scored(spark, sf_dir)
    return tidy(d.groupBy(*KEYS).agg(metrics.loss("bce", y, sigmoid(z)).alias("bce"), *[metrics.loss(n, y, z).alias(n) for n in ("logistic", "hinge", "perceptron", "mistakes")]), 4)


@query("spearman", _SCORED + f", r AS (SELECT symbol, split, rank() OVER (PARTITION BY symbol, split ORDER BY target) + (count(*) OVER (PARTITION BY symbol, split, target) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol, split ORDER BY prediction) + (count(*) OVER (PARTITION BY symbol, split, prediction) - 1) / 2 AS b FROM scored) SELECT symbol, split, count(*) AS n, {o.rounded('rho=corr(a, b)')} FROM r GROUP BY ALL")
def spearman(spark, sf_dir):
    return tidy(metrics.spearman(scored(spark, sf_dir), KEYS, "target", "prediction"))


@query("qlike", _SCORED + f" SELECT symbol, split, {o.rounded('qlike=CASE WHEN min(volatility_20d) > 0 THEN avg((target / volatility_20d) ** 2 - ln((target / volatility_20d) ** 2) - 1) END', 5)} FROM scored WHERE target > 0 GROUP BY ALL")
def qlike(spark, sf_dir):
    return tidy(metrics.qlike(scored(spark, sf_dir).filter("target > 0"), KEYS, "target", "volatility_20d"), 5)


@query("baselines", o.labeled("events") + f", t AS (SELECT symbol, avg(target_volatility_5d) AS mean_baseline, (avg(target_high_volatility) >= 0.5)::BIGINT AS majority_baseline FROM labeled WHERE split = 'train' GROUP BY symbol) SELECT symbol, date, {o.rounded('mean_baseline; persistence_baseline=volatility_5d')}, majority_baseline, {o.whole('persistence_label=volatility_5d > threshold')} FROM labeled JOIN t USING (symbol) WHERE split = 'validation'")
def baselines(spark, sf_dir):
    d = metrics.baselines(event_labels(spark, sf_dir), TARGET, LABEL, "volatility_5d").filter("split = 'validation'")
    return tidy(d.select("symbol", "date", "mean_baseline", "persistence_baseline", "majority_baseline", "persistence_label"))


def cluster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_labels(spark, sf_dir).filter("split = 'validation'")
    x = F.array("rsi_14", F.col("sma_ratio_5_20") * 50, F.col("volume_zscore_20") * 10)
    return native.nearest_centroid(d.select("symbol", F.col("row").alias("id"), x.alias("x"), F.col(LABEL).alias("y")), [[40, 50, 0], [60, 50, 0], [50, 60, 10]])


_CLUSTERS = o.labeled("events") + """, pts AS (SELECT symbol, row AS id, target_high_volatility AS y, rsi_14 AS a, sma_ratio_5_20 * 50 AS b, volume_zscore_20 * 10 AS c FROM labeled WHERE split = 'validation'),
dist AS (SELECT *, sqrt((a - 40) ** 2 + (b - 50) ** 2 + c ** 2) AS d0, sqrt((a - 60) ** 2 + (b - 50) ** 2 + c ** 2) AS d1, sqrt((a - 50) ** 2 + (b - 60) ** 2 + (c - 10) ** 2) AS d2 FROM pts),
cl AS MATERIALIZED (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM dist)"""


@query("nearest_centroid", _CLUSTERS + f" SELECT symbol, id, {o.whole('cluster')}, {o.rounded('distance=least(d0, d1, d2)')} FROM cl")
def nearest_centroid(spark, sf_dir):
    return tidy(cluster_points(spark, sf_dir).select("symbol", "id", "cluster", "distance"))


@query("clustering_metrics", _CLUSTERS + f""", cen AS (SELECT symbol, cluster, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM cl GROUP BY ALL),
ine AS (SELECT symbol, count(*) AS n, count(DISTINCT cluster) AS k, sum((a - ma) ** 2 + (b - mb) ** 2 + (c - mc) ** 2) AS inertia FROM cl JOIN cen USING (symbol, cluster) GROUP BY symbol),
pd AS (SELECT p.symbol, p.id, p.cluster AS ci, q.cluster AS cj, avg(sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2 + (p.c - q.c) ** 2)) AS d FROM cl p JOIN cl q ON p.symbol = q.symbol AND p.id <> q.id GROUP BY ALL),
sil AS (SELECT symbol, id, min(d) FILTER (ci = cj) AS own, min(d) FILTER (ci <> cj) AS oth FROM pd GROUP BY ALL)
SELECT symbol, n, k, {o.rounded('inertia=any_value(inertia); silhouette=CASE WHEN k > 1 AND k < n THEN avg(CASE WHEN own IS NULL THEN 0 ELSE (oth - own) / greatest(oth, own) END) END', 4)} FROM ine LEFT JOIN sil USING (symbol) GROUP BY symbol, n, k""")
def clustering_metrics(spark, sf_dir):
    return tidy(metrics.clustering_metrics(cluster_points(spark, sf_dir), ["symbol"]), 4)


@query("cluster_labels", _CLUSTERS + f" SELECT symbol, {o.whole('cluster')}, {o.rounded('share=avg(y)')}, {o.whole('label=avg(y) >= 0.5')} FROM cl GROUP BY symbol, cluster")
def cluster_labels(spark, sf_dir):
    return tidy(metrics.cluster_labels(cluster_points(spark, sf_dir), ["symbol"]))


@query("standardize", o.labeled("events") + f", s AS (SELECT symbol, {', '.join(f'avg({c}) AS m_{c}, sqrt(var_pop({c})) AS s_{c}' for c in X)} FROM labeled WHERE split = 'train' GROUP BY symbol) SELECT symbol, date, {o.rounded('; '.join(f'{c}=coalesce(({c} - m_{c}) / nullif(s_{c}, 0), 0)' for c in X), 5)} FROM labeled JOIN s USING (symbol) WHERE split = 'validation'")
def standardize(spark, sf_dir):
    d = event_labels(spark, sf_dir)
    return tidy(native.scale(d, native.fit_scaler(d, X), X).filter("split = 'validation'").select("symbol", "date", *X), 5)


@query("simple_linear", o.labeled("events") + f" SELECT symbol, {o.rounded('slope=regr_slope(target_volatility_5d, volatility_5d); intercept=regr_intercept(target_volatility_5d, volatility_5d)', 5)} FROM labeled WHERE split = 'train' GROUP BY symbol")
def simple_linear(spark, sf_dir):
    return tidy(native.fit_simple_linear(event_labels(spark, sf_dir), "volatility_5d", TARGET), 5)


_FIT = "symbol, count(*) AS n, " + o.rounded("mae=avg(abs(e)); rmse=sqrt(avg(e ** 2)); r2=1 - avg(e ** 2) / nullif(var_pop(t), 0)", 4) + ", count(*) FILTER (t - e < 0) AS n_negative"


def fit_quality(p: DataFrame) -> DataFrame:
    return tidy(metrics.regression_metrics(p, ["symbol"], TARGET).select("symbol", "n", "mae", "rmse", "r2", "n_negative"), 4)  # a forecast far off has a squared error of more digits than a double's


@query("least_squares", o.labeled("events") + o.residuals("labeled", X, TARGET) + f" SELECT {_FIT} FROM residuals WHERE split = 'validation' GROUP BY symbol")
def least_squares(spark, sf_dir):
    d = event_labels(spark, sf_dir)
    return fit_quality(native.predict_linear(d, native.fit_least_squares(d, X, TARGET), X).filter("split = 'validation'"))


@query("polynomial", o.labeled("events") + """, zs AS (SELECT symbol, split, target_volatility_5d, (volatility_20d - avg(volatility_20d) FILTER (split = 'train') OVER p) / stddev_pop(volatility_20d) FILTER (split = 'train') OVER p AS z1 FROM labeled WINDOW p AS (PARTITION BY symbol)),
powers AS (SELECT *, z1 ** 2 AS z2, z1 ** 3 AS z3 FROM zs)""" + o.residuals("powers", ["z1", "z2", "z3"], TARGET) + f" SELECT {_FIT} FROM residuals WHERE split = 'validation' GROUP BY symbol")
def polynomial(spark, sf_dir):
    d = event_labels(spark, sf_dir)
    z = native.with_powers(native.scale(d, native.fit_scaler(d, ["volatility_20d"]), ["volatility_20d"]), "volatility_20d", 3)
    columns = ["volatility_20d", "volatility_20d__2", "volatility_20d__3"]
    return fit_quality(native.predict_linear(z, native.fit_least_squares(z, columns, TARGET), columns).filter("split = 'validation'"))


@query("elastic_net", o.labeled("events") + o.elastic_net("labeled", X, TARGET, 0.05, 0.5) + f" SELECT {_FIT} FROM residuals WHERE split = 'validation' GROUP BY symbol")
def elastic_net(spark, sf_dir):
    d = event_labels(spark, sf_dir)
    z = native.scale(d, native.fit_scaler(d, X), X)
    return fit_quality(native.predict_linear(z, native.fit_elastic_net(z, X, TARGET, 0.05, 0.5), X).filter("split = 'validation'"))


HAR = ["har_d", "har_w", "har_m"]


# one series: its own least-squares weights are the pooled prior, and shrinking to them changes nothing
@query("log_har", o.labeled("lineitem") + """, har AS (SELECT symbol, split, target_volatility_5d AS t, ln(target_volatility_5d) AS log_target, ln(greatest(abs(return_1d) * sqrt(252), 0.01)) AS har_d, ln(volatility_5d) AS har_w, ln(volatility_20d) AS har_m FROM labeled WHERE target_volatility_5d > 0 AND volatility_5d > 0 AND volatility_20d > 0)"""
  + o.residuals("har", HAR, "log_target", "t AS target") + f", spread AS (SELECT symbol, var_samp(e) AS s2 FROM residuals WHERE split = 'train' GROUP BY symbol) SELECT {_FIT} FROM (SELECT symbol, target AS t, target - exp(t - e + s2 / 2) AS e FROM residuals JOIN spread USING (symbol) WHERE split = 'validation') GROUP BY symbol")
def log_har(spark, sf_dir):
    d = features.har_features(event_labels(spark, sf_dir, bars.lineitem_bars)).withColumn("log_target", F.when(F.col(TARGET) > 0, F.log(TARGET)))
    p = native.predict_linear(d, native.fit_ridge_to_prior(d, HAR, "log_target", 0.1, native.pooled_prior(d, HAR, "log_target")), HAR, "mu")
    s2 = p.filter("split = 'train'").groupBy("symbol").agg(F.var_samp(F.col("log_target") - F.col("mu")).alias("s2"))
    p = p.join(s2, "symbol").withColumn("prediction", native.lognormal_mean(F.col("mu"), F.col("s2"))).filter("split = 'validation'")
    return fit_quality(p)


@query("principal_components")
def principal_components(spark, sf_dir):
    d = event_labels(spark, sf_dir)
    z = native.scale(d, native.fit_scaler(d, X), X)
    return tidy(native.project(z, native.fit_pca(z, X, 3), X).filter("split = 'validation'").select("symbol", "date", *[F.col("pc")[i].alias(f"pc{i}") for i in range(3)]))


@query("gaussian_nb", o.labeled("lineitem") + f""", t AS (SELECT * FROM labeled WHERE split = 'train'), v AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({c})' for c in X)}) AS v FROM t),
m AS (SELECT target_high_volatility AS k, count(*) / (SELECT count(*) FROM t) AS prior, {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) + (SELECT v FROM v) AS v_{c}' for c in X)} FROM t GROUP BY 1),
l AS (SELECT date, k, ln(prior) + {' + '.join(f'-0.5 * (ln(2 * pi() * v_{c}) + ({c} - m_{c}) ** 2 / v_{c})' for c in X)} AS z FROM labeled, m WHERE split = 'validation')
SELECT date, {o.rounded('probability=1 / (1 + exp(b.z - a.z))', 5)}, {o.whole('label=a.z > b.z')} FROM l a JOIN l b USING (date) WHERE a.k = 1 AND b.k = 0""")
def gaussian_nb(spark, sf_dir):
    d = lineitem_labels(spark, sf_dir)
    p = native.predict_gaussian_nb(d, native.fit_gaussian_nb(d, X, LABEL), X).filter("split = 'validation'")
    return tidy(p.select("date", "probability", "label"), 5)


@query("nearest_neighbours", o.labeled("events") + f""", t AS (SELECT symbol, row, rsi_14, volume_zscore_20, target_high_volatility AS y FROM labeled WHERE split = 'train'),
d AS (SELECT q.symbol, q.row, t.y, row_number() OVER (PARTITION BY q.symbol, q.row ORDER BY sqrt((q.rsi_14 - t.rsi_14) ** 2 + (q.volume_zscore_20 - t.volume_zscore_20) ** 2), t.row) AS k FROM labeled q JOIN t ON t.symbol = q.symbol WHERE q.split = 'validation')
SELECT symbol, row, {o.rounded('probability=avg(y)')}, {o.whole('label=avg(y) > 0.5')} FROM d WHERE k <= 5 GROUP BY symbol, row""")
def nearest_neighbours(spark, sf_dir):
    d = event_labels(spark, sf_dir).withColumn("y", F.col(LABEL))
    return tidy(native.nearest_neighbours(d.filter("split = 'validation'"), d.filter("split = 'train'"), ["rsi_14", "volume_zscore_20"], 5))


_REPLICATES = """, h AS MATERIALIZED (SELECT symbol, y, score, target, prediction, volatility_20d, row_number() OVER (PARTITION BY symbol ORDER BY row) - 1 AS row FROM scored WHERE split = 'test'),
sz AS (SELECT symbol, count(*) AS n FROM h GROUP BY symbol), blocks AS (SELECT symbol, n, r, unnest(range(ceil(n / 20)::BIGINT)) AS b FROM (SELECT symbol, n, unnest(range(2000)) AS r FROM sz WHERE n >= 20)),
idx AS (SELECT symbol, r AS replicate, (r * 7919 + b * 104729) % (n - 19) + k AS row FROM blocks, range(20) AS e(k) WHERE b * 20 + k < n),
rep AS (SELECT i.symbol, replicate, avg(abs(target - prediction)) AS a, avg(abs(target - volatility_20d)) AS b FROM idx i JOIN h ON h.symbol = i.symbol AND h.row = i.row GROUP BY ALL)"""


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol and replicate the mean absolute error of two forecasts on the test rows."""
    from pyspark.sql import Window

    d = scored(spark, sf_dir).filter("split = 'test'").withColumn("row", F.row_number().over(Window.partitionBy("symbol").orderBy("row")) - 1)
    sizes = d.groupBy("symbol").agg(F.count("*").cast("int").alias("n"))
    index = resample.formula_index(sizes, ["symbol"], resample.REPLICATES)
    rows = resample.replicated(d, index, ["symbol"])
    return rows.groupBy("symbol", "replicate").agg(F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("a"), F.avg(F.abs(F.col("target") - F.col("volatility_20d"))).alias("b"))


_BOUNDS = "low=quantile_cont({x}, 0.025); high=quantile_cont({x}, 0.975); se=stddev_samp({x})"


@query("bootstrap_interval", _SCORED + _REPLICATES + f" SELECT symbol, count(*) AS n, count(a) AS valid, {o.rounded(_BOUNDS.format(x='a'), 5)} FROM rep GROUP BY symbol")
def bootstrap_interval(spark, sf_dir):
    return tidy(resample.interval(replicates(spark, sf_dir), ["symbol"], "a"), 5)


@query("paired_comparison", _SCORED + _REPLICATES + f""", g AS (SELECT symbol, count(*) AS n, count(b - a) AS valid, quantile_cont(b - a, 0.025) AS low, quantile_cont(b - a, 0.975) AS high, stddev_samp(b - a) AS se FROM rep GROUP BY symbol)
SELECT symbol, n, valid, {o.rounded('low; high; se', 5)}, low > 0 OR high < 0 AS excludes_zero, CASE WHEN low > 0 THEN 'a better' WHEN high < 0 THEN 'b better' ELSE 'inconclusive' END AS verdict FROM g""")
def paired_comparison(spark, sf_dir):
    r = replicates(spark, sf_dir)
    return tidy(resample.paired_comparison(r.select("symbol", "replicate", F.col("a").alias("v")), r.select("symbol", "replicate", F.col("b").alias("v")), ["symbol"], "v", False), 5)


@query("leaderboard", _SCORED + _REPLICATES + f""", long AS (SELECT symbol, replicate, unnest(['short', 'long']) AS model, unnest([a, b]) AS v FROM rep),
pts AS (SELECT symbol, model, avg(v) AS v, row_number() OVER (PARTITION BY symbol ORDER BY avg(v), model) AS rank FROM long GROUP BY symbol, model),
lead AS (SELECT symbol, model AS leader FROM pts WHERE rank = 1), gaps AS (SELECT l.symbol, l.model, l.v - k.v AS gap FROM long l JOIN lead USING (symbol) JOIN long k ON k.symbol = l.symbol AND k.model = leader AND k.replicate = l.replicate),
b AS (SELECT symbol, model, quantile_cont(gap, 0.025) AS low, quantile_cont(gap, 0.975) AS high FROM gaps GROUP BY ALL)
SELECT symbol, model, {o.rounded('v', 5)}, rank, leader, {o.rounded('low; high', 5)}, model = leader OR (low <= 0 AND high >= 0) AS tied_with_leader FROM pts JOIN lead USING (symbol) JOIN b USING (symbol, model)""")
def leaderboard(spark, sf_dir):
    r = replicates(spark, sf_dir).select("symbol", "replicate", F.explode(F.array(F.struct(F.lit("short").alias("model"), F.col("a").alias("v")), F.struct(F.lit("long").alias("model"), F.col("b").alias("v")))).alias("x")).select("symbol", "replicate", "x.*")
    points = r.groupBy("symbol", "model").agg(F.avg("v").alias("v"))
    return tidy(resample.leaderboard(points, r, ["symbol"], "v", False).select("symbol", "model", "v", "rank", "leader", "low", "high", "tied_with_leader"), 5)


@query("describe", o.features("events") + f" SELECT symbol, feature, count(x) AS n, {o.rounded('mean_x=avg(x); sd_x=stddev_samp(x); min_x=min(x); max_x=max(x); ' + '; '.join(f'p{p:02d}=quantile_cont(x, {p / 100})' for p in (1, 5, 25, 50, 75, 95, 99)), 5)} FROM (SELECT * FROM (SELECT symbol, {', '.join(X)} FROM features) UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(X)}))) GROUP BY ALL")
def describe(spark, sf_dir):
    return tidy(reports.describe(event_features(spark, sf_dir).select("symbol", *X), ["symbol"], X), 5)


_PAIRS = [(a, b) for i, a in enumerate([*X, TARGET]) for b in [*X, TARGET][i + 1 :]]


@query("correlations", o.labeled("events") + ", c AS (SELECT symbol, " + ", ".join(f"corr({a}, {b}) AS c{i}" for i, (a, b) in enumerate(_PAIRS)) + " FROM labeled GROUP BY symbol) " + " UNION ALL ".join(f"SELECT symbol, '{a}' AS a, '{b}' AS b, {o.rounded(f'r=c{i}', 5)} FROM c" for i, (a, b) in enumerate(_PAIRS)))
def correlations(spark, sf_dir):
    return tidy(reports.correlations(event_labels(spark, sf_dir), ["symbol"], [*X, TARGET]), 5)


@query("quarterly_confusion", o.labeled("lineitem") + f", s AS (SELECT date, target_high_volatility AS y, (volatility_5d > threshold)::INT AS label FROM labeled) SELECT {o.whole('year=year(date); quarter=quarter(date)')}, count(*) AS n, count(*) FILTER (y = 1 AND label = 1) AS tp, count(*) FILTER (y <> 1 AND label = 1) AS fp, count(*) FILTER (y = 1 AND label <> 1) AS fn, {o.whole('n_positive=sum(y)')} FROM s GROUP BY year(date), quarter(date)")
def quarterly_confusion(spark, sf_dir):
    d = lineitem_labels(spark, sf_dir).select("date", F.col(LABEL).alias("y"), (F.col("volatility_5d") > F.col("threshold")).cast("int").alias("label"))
    return tidy(reports.quarterly_confusion(d, []))


@query("crosstab", o.labeled("events") + " SELECT coalesce(symbol, 'All') AS a, coalesce(target_high_volatility::VARCHAR, 'All') AS b, count(*) AS n FROM labeled GROUP BY CUBE (symbol, target_high_volatility)")
def crosstab(spark, sf_dir):
    return reports.crosstab(event_labels(spark, sf_dir), "symbol", LABEL)


@query("yearly_rows", o.labeled("lineitem") + f" SELECT symbol, {o.whole('year=year(date)')}, count(*) AS n_rows, count(*) FILTER (split LIKE 'gap%') AS n_removed, {o.whole('n_positive=sum(target_high_volatility)')} FROM labeled GROUP BY symbol, year(date)")
def yearly_rows(spark, sf_dir):
    return tidy(reports.yearly_rows(lineitem_labels(spark, sf_dir).withColumn("removed", F.col("split").startswith("gap")), ["symbol"], "removed", LABEL))


@query("top_features", o.labeled("events") + ", c AS (SELECT symbol, " + ", ".join(f"abs(corr({x}, {TARGET})) AS {x}" for x in X) + f" FROM labeled GROUP BY symbol), l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r DESC NULLS LAST, feature) AS k FROM (UNPIVOT c ON {', '.join(X)} INTO NAME feature VALUE r)) SELECT symbol, max(feature) FILTER (k = 1) AS top_1, max(feature) FILTER (k = 2) AS top_2, max(feature) FILTER (k = 3) AS top_3 FROM l GROUP BY symbol")
def top_features(spark, sf_dir):
    c = reports.correlations(event_labels(spark, sf_dir), ["symbol"], [*X, TARGET]).filter(F.col("b") == TARGET).select("symbol", F.col("a").alias("feature"), F.abs("r").alias("r"))
    return reports.top_by_group(c, ["symbol"], "r", "feature")


@query("pivot_counts", o.labeled("events") + " SELECT symbol, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM labeled GROUP BY symbol")
def pivot_counts(spark, sf_dir):
    return reports.pivot_counts(event_labels(spark, sf_dir).filter(F.col("split").isin(*splits.SPLITS)), "symbol", "split", list(splits.SPLITS))


@query("pivot_max", o.labeled("events") + f" SELECT symbol, {o.rounded('; '.join(f'{s}=max(target_volatility_5d) FILTER (split = {chr(39)}{s}{chr(39)})' for s in splits.SPLITS))} FROM labeled GROUP BY symbol")
def pivot_max(spark, sf_dir):
    return tidy(reports.pivot_max(event_labels(spark, sf_dir), "symbol", "split", list(splits.SPLITS), TARGET))


@query("lookback_windows", o.features("lineitem") + f", f AS (SELECT symbol, date, rsi_14, intraday_range, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM features WHERE rsi_14 IS NOT NULL AND intraday_range IS NOT NULL) SELECT symbol, date, 60::BIGINT AS length, {o.rounded('first_rsi=lag(rsi_14, 59) OVER (PARTITION BY symbol ORDER BY date); last_range=intraday_range', 5)} FROM f QUALIFY k >= 60")
def lookback_windows(spark, sf_dir):
    d = features.lookback_windows(features.add_features(bars.lineitem_bars(spark, sf_dir)), 60, ("rsi_14", "intraday_range"))
    return tidy(d.select("symbol", "date", F.size("window").alias("length"), F.col("window")[0][0].alias("first_rsi"), F.col("window")[59][1].alias("last_range")), 5)


@query("event_windows", o.spikes("events") + f" SELECT f.symbol, {o.whole('event_pos=s.pos; offset=f.pos - s.pos').replace(' AS offset', ' AS \"offset\"')}, {o.rounded('return_1d=f.return_1d')} FROM flagged s JOIN features f ON f.symbol = s.symbol AND f.pos BETWEEN s.pos - 10 AND s.pos + 25 WHERE s.is_spike")
def event_windows(spark, sf_dir):
    d = event_features(spark, sf_dir)
    return tidy(features.event_windows(d, event_spikes(spark, sf_dir).filter("is_spike")).select("symbol", "event_pos", "offset", "return_1d"))


@query("clipped_metrics", _SCORED + f", p AS (SELECT *, prediction - threshold AS q FROM scored) SELECT symbol, split, count(*) AS n, count(*) FILTER (q < 0) AS n_negative, {o.rounded('mae=avg(abs(target - q)); rmse=sqrt(avg((target - q) ** 2)); clipped_mae=avg(abs(target - greatest(q, 0))); clipped_rmse=sqrt(avg((target - greatest(q, 0)) ** 2))', 5)} FROM p GROUP BY ALL")
def clipped_metrics(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("prediction", F.col("prediction") - F.col("threshold"))
    return tidy(metrics.clipped_metrics(d, KEYS, "target").select("symbol", "split", "n", "n_negative", "mae", "rmse", "clipped_mae", "clipped_rmse"), 5)


@query("segment_metrics", o.spikes("events") + f", s AS (SELECT symbol, CASE WHEN is_spike THEN 'direct_spike' WHEN coverage > 0 THEN 'spike_affected' ELSE 'unaffected' END AS segment, target_volatility_5d AS t, volatility_5d AS p FROM covered WHERE split = 'test') SELECT symbol, segment, count(*) AS n, {o.rounded('mae=avg(abs(t - p)); rmse=sqrt(avg((t - p) ** 2))', 5)} FROM s GROUP BY ALL")
def segment_metrics(spark, sf_dir):
    d = event_spikes(spark, sf_dir).filter("split = 'test'").select("symbol", F.col("diagnostic_segment").alias("segment"), F.col(TARGET).alias("y"), F.col("volatility_5d").alias("prediction"))
    return tidy(metrics.regression_metrics(d, ["symbol", "segment"]).select("symbol", "segment", "n", "mae", "rmse"), 5)


_TWO_RUNS = _SCORED + """, a AS (SELECT symbol, date, target, prediction FROM scored WHERE split = 'validation' AND row % 17 <> 0),
b AS (SELECT symbol, date, CASE WHEN row % 13 = 0 THEN target + 1 ELSE target END AS target, volatility_20d AS prediction FROM scored WHERE split = 'validation' AND row % 19 <> 0)"""


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two forecasts of the validation rows which disagree on some rows and targets."""
    d = scored(spark, sf_dir).filter("split = 'validation'")
    a = d.filter("row % 17 <> 0").select("symbol", "date", "target", "prediction")
    b = d.filter("row % 19 <> 0").select("symbol", "date", F.when(F.col("row") % 13 == 0, F.col("target") + 1).otherwise(F.col("target")).alias("target"), F.col("volatility_20d").alias("prediction"))
    return a, b


@query("misaligned", _TWO_RUNS + """ SELECT symbol, date, CASE WHEN a.date IS NULL THEN 'only_second' WHEN b.date IS NULL THEN 'only_first' ELSE 'target' END AS reason
  FROM (SELECT symbol, date, target FROM a) a FULL JOIN (SELECT symbol, date, target FROM b) b USING (symbol, date) WHERE a.target IS DISTINCT FROM b.target""")
def misaligned(spark, sf_dir):
    return checks.misaligned(*two_runs(spark, sf_dir), ["symbol", "date"], "target")


@query("paired_violations", _SCORED + """, p AS (SELECT symbol, target AS y, CASE WHEN row % 11 = 0 THEN NULL WHEN row % 7 = 0 THEN 'nan'::DOUBLE ELSE prediction END AS p FROM scored)
SELECT symbol, count(*) AS n, count(*) FILTER (y IS NULL OR p IS NULL) AS n_null, count(*) FILTER (isnan(y) OR isinf(y) OR isnan(p) OR isinf(p)) AS n_not_finite FROM p GROUP BY symbol""")
def paired_violations(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("prediction", F.when(F.col("row") % 11 == 0, F.lit(None)).when(F.col("row") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("prediction")))
    return checks.paired_violations(d, ["symbol"], "target", "prediction")


@query("parity", _TWO_RUNS + """ SELECT symbol, count(*) AS n, count(*) FILTER (abs(a.prediction - b.prediction) > 1e-8 + 0.5::DOUBLE * abs(b.prediction)) AS n_differ, round(max(abs(a.prediction - b.prediction)), 5) AS largest, count(*) FILTER (abs(a.prediction - b.prediction) > 1e-8 + 0.5::DOUBLE * abs(b.prediction)) = 0 AS same FROM a JOIN b USING (symbol, date) GROUP BY symbol""")
def parity(spark, sf_dir):
    a, b = two_runs(spark, sf_dir)
    return tidy(checks.parity(a, b, ["symbol", "date"], ["symbol"], "prediction", rtol=0.5, atol=1e-8), 5)


@query("split_contract", o.labeled("events") + """, b AS (SELECT symbol, split, count(*) AS n, min(row) AS lo, max(row) AS hi, min(date) AS first_date, max(date) AS last_date FROM labeled GROUP BY ALL),
n AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'gap1' THEN 1 WHEN 'validation' THEN 2 WHEN 'gap2' THEN 3 ELSE 4 END AS place FROM b),
l AS (SELECT *, lag(hi) OVER w AS before, lag(last_date) OVER w AS date_before FROM n WINDOW w AS (PARTITION BY symbol ORDER BY place))
SELECT symbol, split, n AS n_rows, hi - lo + 1 = n AS contiguous, coalesce(lo = before + 1, lo = 0) AS follows, coalesce(first_date > date_before, true) AS later, split NOT LIKE 'gap%' OR n = 5 AS gap_ok FROM l""")
def split_contract(spark, sf_dir):
    return tidy(checks.split_contract(event_labels(spark, sf_dir)))


@query("fold_spread", _SCORED + """, f AS (SELECT symbol, target, prediction, row, ntile(3) OVER (PARTITION BY symbol ORDER BY row) AS fold FROM scored WHERE split = 'validation'), m AS (SELECT symbol, fold, avg(abs(target - prediction)) AS v FROM f GROUP BY ALL), a AS (SELECT symbol, avg(abs(target - prediction)) AS v FROM f GROUP BY symbol)
SELECT a.symbol, round(max(m.v) FILTER (fold = 1), 5) AS fold_1, round(max(m.v) FILTER (fold = 2), 5) AS fold_2, round(max(m.v) FILTER (fold = 3), 5) AS fold_3, round(any_value(a.v), 5) AS pooled, round(max(m.v) - min(m.v), 5) AS spread FROM a LEFT JOIN m USING (symbol) GROUP BY a.symbol""")
def fold_spread(spark, sf_dir):
    from pyspark.sql import Window

    d = scored(spark, sf_dir).filter("split = 'validation'").withColumn("fold", F.ntile(3).over(Window.partitionBy("symbol").orderBy("row")))
    error = F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("v")
    return tidy(checks.fold_spread(d.groupBy("symbol", "fold").agg(error), d.groupBy("symbol").agg(error), ["symbol"], "v", [1, 2, 3]), 5)


@query("half_vote", _SCORED + f" SELECT symbol, date, {o.rounded('vote=CASE WHEN score > 0 THEN ln(score / (1 + score) / (1 - score / (1 + score))) * 3 / 4 END', 4)} FROM scored WHERE split = 'validation'")
def half_vote(spark, sf_dir):
    d = scored(spark, sf_dir).filter("split = 'validation'")
    return tidy(d.select("symbol", "date", metrics.half_vote(F.col("score") / (1 + F.col("score")), F.lit(3)).alias("vote")), 4)


@query("align_clusters", _CLUSTERS + ", n AS (SELECT y AS a, cluster AS b, count(*) AS n FROM cl GROUP BY ALL) SELECT b::BIGINT AS b, arg_max(a, n * 10 - a)::BIGINT AS \"as\" FROM n GROUP BY b")
def align_clusters(spark, sf_dir):
    return tidy(metrics.align_clusters(cluster_points(spark, sf_dir).select(F.col("y").alias("a"), F.col("cluster").alias("b")), "a", "b"))


@query("against_baseline", _SCORED + f""", m AS (SELECT symbol, unnest(['short', 'long', 'mean']) AS model, unnest([avg(abs(target - prediction)), avg(abs(target - volatility_20d)), avg(abs(target - threshold))]) AS v FROM scored WHERE split = 'test' GROUP BY symbol)
SELECT symbol, model, {o.rounded('v; best_baseline=max(v) FILTER (model = $$mean$$) OVER (PARTITION BY symbol)', 5)}, v < max(v) FILTER (model = 'mean') OVER (PARTITION BY symbol) AS beats_baseline FROM m""")
def against_baseline(spark, sf_dir):
    d = scored(spark, sf_dir).filter("split = 'test'")
    mae = lambda c: F.avg(F.abs(F.col("target") - F.col(c)))
    m = d.groupBy("symbol").agg(*[mae(c).alias(n) for n, c in (("short", "prediction"), ("long", "volatility_20d"), ("mean", "threshold"))]).unpivot(["symbol"], ["short", "long", "mean"], "model", "v")
    return tidy(resample.against_baseline(m, ["symbol"], "v", False, ["mean"]), 5)


@query("set_operations", o.labeled("events") + """, a AS (SELECT DISTINCT date FROM labeled WHERE symbol = 'click'), b AS (SELECT DISTINCT date FROM labeled WHERE symbol = 'view')
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def set_operations(spark, sf_dir):
    d = event_labels(spark, sf_dir)
    a, b = (d.filter(F.col("symbol") == s).select("date").distinct() for s in ("click", "view"))
    n = lambda part, x: x.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return n("both", a.intersect(b)).unionByName(n("first_only", a.exceptAll(b))).unionByName(n("either", a.unionByName(b).distinct()))


@query("payload_rows", o.bars("orders") + f" SELECT date, {o.rounded('open; high; low; close; volume', 4)} FROM bars")
def payload_rows(spark, sf_dir):
    """Bars as text in JSON payloads, one a symbol and year, and back."""
    d = bars.order_bars(spark, sf_dir)
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 4))
    row = F.struct(F.date_format("date", "MM/dd/yyyy").alias("date"), *[money(c).alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("string").alias("volume"))
    p = d.groupBy("symbol", F.year("date").alias("year")).agg(F.to_json(F.struct(F.struct(F.lit(200).alias("rCode")).alias("status"), F.struct(F.collect_list(row).alias("rows")).alias("data"))).alias("payload"))
    return tidy(bars.payload_rows(p.select("payload")), 4)


@query("row_violations", o.bars("orders") + ", p AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY close, date) AS place FROM bars), q AS (SELECT *, lag(date) OVER (PARTITION BY symbol ORDER BY place) AS before FROM p) SELECT symbol, count(date) - count(DISTINCT date) AS n_repeated, count(*) FILTER (date >= before) AS n_out_of_order, 0::BIGINT AS n_blank FROM q GROUP BY symbol")
def row_violations(spark, sf_dir):
    from pyspark.sql import Window

    d = bars.order_bars(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("close", "date")))
    return bars.row_violations(d)


@query("years_before", o.bars("lineitem") + " SELECT date, (date - INTERVAL 10 YEAR)::DATE AS earlier FROM bars")
def years_before(spark, sf_dir):
    return bars.lineitem_bars(spark, sf_dir).select("date", bars.years_before(F.col("date"), 10).alias("earlier"))


@query("report_json", o.labeled("events") + """ SELECT symbol, '{"n":' || count(*) || ',"n_high":' || sum(target_high_volatility) || ',"bad":null}' AS json FROM labeled GROUP BY symbol""")
def report_json(spark, sf_dir):
    d = event_labels(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.sum(LABEL).alias("n_high"), F.lit(float("nan")).alias("bad"))
    return reports.as_json(d, ["symbol"])


def modeling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_labels(spark, sf_dir).filter(F.col("split").isin("train", "validation"))
    return d.select("symbol", F.col("row").cast("long").alias("row"), F.col("split").alias("part"), F.col(LABEL).alias("y"), *X)


GRID = {
    "logistic": {"penalty": [0.01, 0.1], "rounds": [1000]}, "perceptron": {"epochs": [20]}, "slp": {"epochs": [40]}, "mlp": {"epochs": [40], "hidden": [4]}, "svm": {"c": [0.1], "rounds": [1000]}, "decision_tree": {"depth": [2, 3]}, "random_forest": {"trees": [15], "depth": [3]},
    "gradient_boosting": {"trees": [20], "depth": [2]}, "xgboost": {"trees": [20], "depth": [2]}, "adaboost": {"stumps": [15]}, "knn": {"k": [5, 15]}, "kernel_perceptron": {"gamma": [0.5], "epochs": [5]}, "stacking": {},
}


@query("model_grid")
def model_grid(spark, sf_dir):
    ship(spark)
    p = grid.fit_predict(modeling_table(spark, sf_dir), grid.candidates(spark, GRID), X).filter("part = 'validation' AND score IS NOT NULL")
    return metrics.rank_metrics(p, ["symbol", "model", "id"])


@query("model_selection")
def model_selection(spark, sf_dir):
    return metrics.select_candidate(model_grid(spark, sf_dir), "classification", ["symbol", "model"])


@query("walk_forward")
def walk_forward(spark, sf_dir):
    d = modeling_table(spark, sf_dir).filter("part = 'train'")
    p = grid.walk_forward(d, grid.candidates(spark, {"logistic": {"rounds": [500]}, "decision_tree": {}}), X)
    return metrics.rank_metrics(p.filter("score IS NOT NULL"), ["symbol", "model", "fold"])


def permuted_scores(spark: SparkSession, sf_dir: str, repeats: int = 30) -> tuple[DataFrame, DataFrame]:
    """Validation scores per symbol, and the same by feature and repeat with that feature's blocks in another order."""
    d = modeling_table(spark, sf_dir)
    fitted = grid.fit_models(d, grid.candidates(spark, {"logistic": {"rounds": [500]}}), X)
    held = d.filter("part = 'validation'")
    score = lambda rows, more: metrics.rank_metrics(grid.predict_models(rows, fitted, X, more).join(held.select("symbol", "row", "y"), ["symbol", "row"]), ["symbol", *more])
    # a row's features move as one, so that there is one plan; then each feature in turn takes its moved value
    moved = resample.block_permutation(held.withColumn("moved", F.struct(*X)), ["symbol"], "moved", repeats)
    shuffled = moved.withColumn("feature", F.explode(F.array(*[F.lit(x) for x in X]))).withColumns({x: F.when(F.col("feature") == x, F.col(f"moved.{x}")).otherwise(F.col(x)) for x in X}).drop("moved")
    return score(held, []), score(shuffled, ["feature", "repeat"])


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    return resample.permutation_importance(*permuted_scores(spark, sf_dir), ["symbol"], "roc_auc")


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    d = modeling_table(spark, sf_dir)
    p = grid.fit_predict(d, grid.candidates(spark, {"kmeans": {"k": [2, 3], "restarts": [3]}}), X)
    return p.groupBy("symbol", "id", "label").agg(F.count("*").alias("n_rows"))


@query("agglomerative_clusters")
def agglomerative_clusters(spark, sf_dir):
    d = modeling_table(spark, sf_dir)
    p = grid.fit_predict(d, grid.candidates(spark, {"agglomerative": {"k": [2], "linkage": ["ward", "average"]}}), X)
    return p.groupBy("symbol", "id", "label").agg(F.count("*").alias("n_rows"))


@query("sequence_models")
def sequence_models(spark, sf_dir):
    """GRU and Transformer over 20-bar windows, pretrained and fine-tuned on the training rows of each series."""
    from tidemark.models.sequence import transfer_runs

    d = event_labels(spark, sf_dir)
    w = features.lookback_windows(features.add_features(bars.event_bars(spark, sf_dir)), 20)
    windows = d.filter(F.col("split").isin("train", "validation")).select("symbol", "date", "row", F.col("split").alias("part"), F.col(LABEL).alias("y")).join(w, ["symbol", "date"])
    scores = transfer_runs(windows, seeds=(0,), pretraining=1, epochs=2, width=8).filter("part = 'validation'")
    return metrics.rank_metrics(scores.groupBy("symbol", "kind", "row", "y").agg(F.avg("score").alias("score")), ["symbol", "kind"])


@query("streaming_bars", o.bars("events") + f" SELECT symbol, date, {_BAR_COLUMNS} FROM bars")
def streaming_bars(spark, sf_dir):
    """The stream's plan over the whole table at once: the same function serves both."""
    from tidemark.streaming.bars import streaming_bars as build

    d = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tidy(build(d).withColumn("date", F.col("date").cast("timestamp_ntz")))
