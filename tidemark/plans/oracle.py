"""SQL for the queries of catalog.py, built from common table expressions that each do one step."""

from __future__ import annotations

from tidemark.schema import FEATURES

_BARS = """bars AS MATERIALIZED (SELECT {symbol} AS symbol, {period} AS date, first({price} ORDER BY {order}) AS open, max({price}) AS high, min({price}) AS low,
  last({price} ORDER BY {order}) AS close, sum({volume})::DOUBLE AS volume FROM {table} WHERE {price} IS NOT NULL AND {period} IS NOT NULL GROUP BY 1, 2)"""
SOURCES = {
    "events": _BARS.format(symbol="event_type", period="date_trunc('hour', ts)", price="value", order="ts, event_id", volume="value", table="events"),
    "lineitem": _BARS.format(symbol="'lineitem'", period="l_shipdate::DATE", price="(l_extendedprice / nullif(l_quantity, 0))", order="l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity", volume="l_quantity", table="lineitem"),
    "orders": _BARS.format(symbol="o_orderpriority", period="o_orderdate::DATE", price="o_totalprice", order="o_orderkey", volume="1", table="orders"),
}
_FEATURES = """,
placed AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS pos, close / nullif(lag(close) OVER w, 0) - 1 AS return_1d, close / nullif(lag(close, 5) OVER w, 0) - 1 AS return_5d,
  greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
smooth AS (SELECT symbol, 14::BIGINT AS pos, avg(gain) AS g, avg(loss) AS l FROM placed WHERE pos BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT s.symbol, s.pos + 1, (s.g * 13 + p.gain) / 14, (s.l * 13 + p.loss) / 14 FROM smooth s JOIN placed p ON p.symbol = s.symbol AND p.pos = s.pos + 1),
strength AS (SELECT symbol, pos, CASE WHEN l = 0 AND g = 0 THEN 50 WHEN l = 0 THEN 100 WHEN g = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END AS rsi_14 FROM smooth),
features AS MATERIALIZED (SELECT p.symbol, date, p.pos, open, high, low, close, volume, return_1d, return_5d,
  CASE WHEN count(return_1d) OVER w5 = 5 THEN stddev_samp(return_1d) OVER w5 * sqrt(252) END AS volatility_5d,
  CASE WHEN count(return_1d) OVER w20 = 20 THEN stddev_samp(return_1d) OVER w20 * sqrt(252) END AS volatility_20d,
  (high - low) / nullif(close, 0) AS intraday_range,
  CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w5 / nullif(avg(close) OVER w20, 0) END AS sma_ratio_5_20, rsi_14,
  CASE WHEN count(volume) OVER w20 = 20 THEN (volume - avg(volume) OVER w20) / nullif(stddev_samp(volume) OVER w20, 0) END AS volume_zscore_20,
  CASE WHEN count(return_1d) OVER f5 = 5 THEN stddev_samp(return_1d) OVER f5 * sqrt(252) END AS target_volatility_5d, lead(date, 5) OVER w AS label_end_date
  FROM placed p LEFT JOIN strength s ON s.symbol = p.symbol AND s.pos = p.pos
  WINDOW w AS (PARTITION BY p.symbol ORDER BY date), w5 AS (PARTITION BY p.symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY p.symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    f5 AS (PARTITION BY p.symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""
_SPLIT = f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS row, count(*) OVER (PARTITION BY symbol) - 10 AS usable FROM features
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)} AND target_volatility_5d IS NOT NULL),
sized AS (SELECT *, floor(usable * 0.7::DOUBLE) AS a, floor(usable * 0.15::DOUBLE) AS b FROM numbered),
split AS MATERIALIZED (SELECT *, CASE WHEN a < 1 OR b < 1 OR usable - a - b < 1 THEN NULL WHEN row < a THEN 'train' WHEN row < a + 5 THEN 'gap1' WHEN row < a + 5 + b THEN 'validation' WHEN row < a + 10 + b THEN 'gap2' ELSE 'test' END AS split FROM sized),
fitted AS (SELECT symbol, quantile_cont(target_volatility_5d, 0.75) AS threshold FROM split WHERE split = 'train' GROUP BY symbol),
labeled AS MATERIALIZED (SELECT s.*, threshold, (target_volatility_5d > threshold)::INT AS target_high_volatility FROM split s JOIN fitted USING (symbol))"""
_SPIKES = """,
fence AS (SELECT symbol, quantile_cont(abs(return_1d), 0.25) AS q1, quantile_cont(abs(return_1d), 0.75) AS q3, 4 * quantile_cont(abs(return_1d), 0.75) - 3 * quantile_cont(abs(return_1d), 0.25) AS fence FROM labeled WHERE split = 'train' GROUP BY symbol),
flagged AS MATERIALIZED (SELECT l.*, fence, abs(return_1d) > fence AS is_spike, row_number() OVER (PARTITION BY symbol, split ORDER BY date) - 1 AS at, count(*) OVER (PARTITION BY symbol, split) AS n FROM labeled l JOIN fence USING (symbol)),
covered AS MATERIALIZED (SELECT f.*, (SELECT count(*) FROM flagged s WHERE s.is_spike AND s.symbol = f.symbol AND s.split = f.split AND f.at BETWEEN s.at - 5 AND s.at + 19) AS coverage FROM flagged f)"""


def bars(source: str) -> str:
    return "WITH RECURSIVE " + SOURCES[source]


def features(source: str) -> str:
    return bars(source) + _FEATURES


def labeled(source: str) -> str:
    return features(source) + _SPLIT


def spikes(source: str) -> str:
    return labeled(source) + _SPIKES


def residuals(table: str, columns: list[str], y: str, more: str = "") -> str:
    """CTEs up to `residuals` (symbol, split, t, e): y less its least-squares forecast from the training rows, for all rows. Each
    step takes one column's part out of the columns after it and out of y."""
    part = "PARTITION BY symbol"
    of_train = lambda x: f"{x} FILTER (split = 'train') OVER ({part})"
    names = [f"x{i}" for i in range(len(columns))]
    keep = "symbol, split, t" + ", target" * bool(more)
    out = f""",
step0 AS MATERIALIZED (SELECT symbol, split, {y} AS t{", " + more if more else ""}, {y} - {of_train(f"avg({y})")} AS e, {", ".join(f"{c} - {of_train(f'avg({c})')} AS {n}" for c, n in zip(columns, names))} FROM {table})"""
    for i, x in enumerate(names):
        less = lambda z: f"{z} - {x} * coalesce({of_train(f'sum({x} * {z})')} / nullif({of_train(f'sum({x} * {x})')}, 0), 0) AS {z}"
        out += f",\n{'residuals' if i + 1 == len(names) else f'step{i + 1}'} AS MATERIALIZED (SELECT {keep}, {', '.join(less(z) for z in ['e', *names[i + 1 :]])} FROM step{i})"
    return out


def elastic_net(table: str, columns: list[str], y: str, alpha: float, mix: float, rounds: int = 400) -> str:
    """CTEs up to `residuals` (symbol, split, t, e): coordinate descent on standardised columns, one coordinate a step."""
    k = len(columns)
    of_train = lambda x: f"{x} FILTER (split = 'train') OVER (PARTITION BY symbol)"
    zs = ", ".join(f"coalesce(({c} - {of_train(f'avg({c})')}) / nullif({of_train(f'stddev_pop({c})')}, 0), 0)" for c in columns)
    gram = ", ".join("[" + ", ".join(f"avg(z[{i}] * z[{j}])" for j in range(1, k + 1)) + "]" for i in range(1, k + 1))
    return f""",
zed AS MATERIALIZED (SELECT symbol, split, {y} AS t, {y} - {of_train(f"avg({y})")} AS yc, [{zs}] AS z FROM {table}),
products AS (SELECT symbol, [{gram}] AS a, [{", ".join(f"avg(z[{i}] * yc)" for i in range(1, k + 1))}] AS c FROM zed WHERE split = 'train' GROUP BY symbol),
sums AS MATERIALIZED (SELECT symbol, j, a[j] AS a, c[j] AS c FROM products, range(1, {k + 1}) AS r(j)),
descent AS (SELECT symbol, 0 AS step, [{", ".join(["0.0::DOUBLE"] * k)}] AS w FROM products
  UNION ALL SELECT symbol, step + 1, w[1:j - 1] || [sign(rest) * greatest(abs(rest) - {alpha * mix}::DOUBLE, 0) / (below + {alpha * (1 - mix)}::DOUBLE)] || w[j + 1:]
  FROM (SELECT d.symbol, step, w, j, a[j] AS below, c - list_dot_product(a, w) + a[j] * w[j] AS rest FROM descent d JOIN sums s ON s.symbol = d.symbol AND s.j = d.step % {k} + 1 WHERE step < {rounds * k})),
residuals AS (SELECT symbol, split, t, yc - list_dot_product(z, w) AS e FROM zed JOIN (SELECT symbol, w FROM descent WHERE step = {rounds * k}) USING (symbol))"""


def rounded(names: str, digits: int = 6) -> str:
    """`a b=expr` -> round(a, 6) AS a, round(expr, 6) AS b."""
    out = []
    for item in names.split(";"):
        name, _, value = item.strip().partition("=")
        out.append(f"round(({value or name})::DOUBLE, {digits}) AS {name}")
    return ", ".join(out)


def whole(names: str) -> str:
    out = []
    for item in names.split(";"):
        name, _, value = item.strip().partition("=")
        out.append(f"({value or name})::BIGINT AS {name}")
    return ", ".join(out)
