"""Fits that are aggregations, predictions that are column expressions; all keyed by symbol, all from training rows.

What a fit collects are sums of products: one small matrix for each symbol, solved where the rows of that symbol's sums meet."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio
from tidemark.runtime import ship

TINY = 1e-12


def _train(d: DataFrame) -> DataFrame:
    return d.filter(F.col("split") == "train") if "split" in d.columns else d


def dot(weights: str, columns: list[str]) -> Column:
    return reduce(Column.__add__, [F.col(weights)[i] * F.col(c) for i, c in enumerate(columns)])


def fit_scaler(d: DataFrame, columns: list[str]) -> DataFrame:
    """Per symbol mean and population standard deviation; a constant column's scale is 0."""
    v = lambda c: F.var_pop(c)
    return _train(d).groupBy("symbol").agg(*[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.when(v(c) > TINY, F.sqrt(v(c))).otherwise(0.0).alias(f"{c}__scale") for c in columns])


def scale(d: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Standardised columns; constant ones become 0."""
    joined = d.join(fitted, "symbol")
    return joined.withColumns({c: F.coalesce(ratio(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__scale")), F.when(F.col(c).isNotNull(), 0.0)) for c in columns}).drop(*[f"{c}__{x}" for c in columns for x in ("mean", "scale")])


def gram(d: DataFrame, columns: list[str], y: str | None = None) -> DataFrame:
    """Per symbol n, means and centred sums of products of the columns (and y, last), upper triangle by rows."""
    names = [*columns, *([y] if y else [])]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return _train(d).na.drop("any", subset=names).groupBy("symbol").agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in names]).alias("means"), F.array(*[F.covar_pop(a, b) * F.count("*") for a, b in pairs]).alias("products"))


def _square(products, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = products
    return m + np.triu(m, 1).T


def _solve(sums: DataFrame, k: int, solver) -> DataFrame:
    """solver(n, means, centred products) -> (intercept, weights), once for each symbol's row of sums."""
    ship(sums.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = [(r.symbol, *solver(int(r.n), np.array(r.means), _square(r.products, k))) for r in pdf.itertuples()]
            yield pd.DataFrame([(s, float(i), [float(x) for x in w]) for s, i, w in rows], columns=["symbol", "intercept", "weights"])

    return sums.mapInPandas(run, "symbol string, intercept double, weights array<double>")


def fit_pca(d: DataFrame, columns: list[str], components: int) -> DataFrame:
    """symbol, component, variance, weights: eigenvectors of the sample covariance, largest first; each one's entry of largest
    magnitude is positive."""
    ship(d.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                values, vectors = np.linalg.eigh(_square(r.products, len(columns)) / max(r.n - 1, 1))
                for j, i in enumerate(np.argsort(-values, kind="stable")[:components]):
                    v = vectors[:, i]
                    top = int(np.flatnonzero(np.abs(v) >= np.abs(v).max() - 1e-12)[0])
                    out.append((r.symbol, j, float(values[i]), [float(x) for x in (v if v[top] > 0 else -v)], [float(m) for m in r.means]))
            yield pd.DataFrame(out, columns=["symbol", "component", "variance", "weights", "means"])

    return gram(d, columns).mapInPandas(run, "symbol string, component int, variance double, weights array<double>, means array<double>")


def project(d: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Adds pc: the array of projections."""
    parts = fitted.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "weights"))), lambda x: x["weights"]).alias("_w"), F.first("means").alias("_m"))
    x = F.zip_with(F.array(*columns), "_m", lambda a, b: a - b)
    each = F.transform("_w", lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return d.join(parts, "symbol").withColumn("pc", each).drop("_w", "_m")


def fit_simple_linear(d: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares on one column; a constant column has slope 0."""
    ok = _train(d).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    slope = F.when(F.var_pop(x) > TINY, ratio(F.covar_pop(x, y), F.var_pop(x))).otherwise(0.0)
    return ok.groupBy("symbol").agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"))


def fit_least_squares(d: DataFrame, columns: list[str], y: str) -> DataFrame:
    """symbol, intercept, weights of the least-squares solution of least norm."""
    k = len(columns)

    def solver(n, means, s):
        w = np.linalg.lstsq(s[:k, :k], s[:k, k], rcond=None)[0]
        return means[k] - means[:k] @ w, w

    return _solve(gram(d, columns, y), k + 1, solver)


def with_powers(d: DataFrame, x: str, degree: int) -> DataFrame:
    return d.withColumns({f"{x}__{i}": F.pow(x, F.lit(float(i))) for i in range(2, degree + 1)})


def fit_elastic_net(d: DataFrame, columns: list[str], y: str, alpha: float, mix: float, tolerance: float = 1e-10, rounds: int = 10_000) -> DataFrame:
    """Coordinate descent on sums of products for |r|^2 / 2n + alpha mix |b|_1 + alpha (1 - mix) / 2 |b|^2."""
    k = len(columns)

    def solver(n, means, s):
        a, c, w = s[:k, :k] / n, s[:k, k] / n, np.zeros(k)
        for _ in range(rounds):
            moved = 0.0
            for j in range(k):
                rest = c[j] - a[j] @ w + a[j, j] * w[j]
                below = a[j, j] + alpha * (1 - mix)
                new = np.sign(rest) * max(abs(rest) - alpha * mix, 0.0) / below if below > 0 else 0.0
                moved, w[j] = max(moved, abs(new - w[j])), new
            if moved < tolerance:
                break
        return means[k] - means[:k] @ w, w

    return _solve(gram(d, columns, y), k + 1, solver)


def fit_ridge_to_prior(d: DataFrame, columns: list[str], y: str, kappa: float, prior: list[float] | None = None) -> DataFrame:
    """Weights drawn to a prior: (S + kappa n I) b = s + kappa n prior; kappa 0 is least squares, infinity the prior."""
    k = len(columns)
    towards = np.array(prior if prior is not None else [0.0] * k)

    def solver(n, means, s):
        if kappa == 0:
            w = np.linalg.lstsq(s[:k, :k], s[:k, k], rcond=None)[0]
        elif np.isinf(kappa):
            w = towards
        else:
            w = np.linalg.solve(s[:k, :k] + kappa * n * np.eye(k), s[:k, k] + kappa * n * towards)
        return means[k] - means[:k] @ w, w

    return _solve(gram(d, columns, y), k + 1, solver)


def pooled_prior(d: DataFrame, columns: list[str], y: str) -> list[float]:
    """Within estimator over all symbols: centred sums add up; one small matrix reaches the driver."""
    k, sums = len(columns), gram(d, columns, y)
    total = sums.select(F.posexplode("products").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    s = _square([r.v for r in total], k + 1)
    return [float(x) for x in np.linalg.lstsq(s[:k, :k], s[:k, k], rcond=None)[0]]


def predict_linear(d: DataFrame, fitted: DataFrame, columns: list[str], out: str = "prediction") -> DataFrame:
    return d.join(fitted, "symbol").withColumn(out, F.col("intercept") + dot("weights", columns)).drop("intercept", "weights")


def lognormal_mean(mu: Column, variance: Column) -> Column:
    return F.exp(mu + variance / 2)


def fit_gaussian_nb(d: DataFrame, columns: list[str], y: str, smoothing: float = 1e-9) -> DataFrame:
    """symbol, label, prior and each column's mean and variance, the variance with a share of the largest column variance."""
    t = _train(d)
    wide = t.groupBy("symbol").agg(F.greatest(*[F.var_pop(c) for c in columns]).alias("_v"), F.count("*").alias("_n")) if len(columns) > 1 else t.groupBy("symbol").agg(F.var_pop(columns[0]).alias("_v"), F.count("*").alias("_n"))
    per = t.groupBy("symbol", F.col(y).alias("label")).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in columns]).alias("means"), F.array(*[F.var_pop(c) for c in columns]).alias("vars"))
    return per.join(wide, "symbol").select("symbol", "label", (F.col("n") / F.col("_n")).alias("prior"), "means", F.transform("vars", lambda v: v + smoothing * F.col("_v")).alias("vars"))


def predict_gaussian_nb(d: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """probability of label 1 and the label; a tie is 0."""
    x = F.array(*columns)
    m = fitted.groupBy("symbol").agg(*[F.max_by(F.struct("prior", "means", "vars"), F.when(F.col("label") == k, 1)).alias(f"m{k}") for k in (0, 1)])

    def log_density(k: int) -> Column:
        each = F.zip_with(F.zip_with(x, F.col(f"m{k}.means"), lambda a, b: (a - b) * (a - b)), F.col(f"m{k}.vars"), lambda q, v: -0.5 * (F.log(2 * np.pi * v) + q / v))
        return F.log(F.col(f"m{k}.prior")) + F.aggregate(each, F.lit(0.0), lambda s, v: s + v)

    j = d.join(m, "symbol").withColumn("_z", log_density(1) - log_density(0))
    from tidemark.functions.scalar import sigmoid

    return j.withColumn("probability", sigmoid(F.col("_z"))).withColumn("label", (F.col("_z") > 0).cast("int")).drop("_z", "m0", "m1")


def nearest_neighbours(queries: DataFrame, train: DataFrame, columns: list[str], k: int, weighting: str = "uniform") -> DataFrame:
    """symbol, row, probability, label: Euclidean k nearest training rows, ties by training row; 1 / d weights give exact
    matches all weight. Each symbol's queries meet its own training rows, a series' length each."""
    a = queries.select("symbol", "row", F.array(*columns).alias("_q"))
    b = train.select("symbol", F.col("row").alias("_t"), F.array(*columns).alias("_x"), F.col("y").cast("double").alias("_y"))
    square = F.aggregate(F.zip_with("_q", "_x", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    pairs = a.join(b, "symbol").select("symbol", "row", "_t", "_y", F.sqrt(square).alias("_d"))
    # the k nearest are kept by a window whose limit Spark pushes below the shuffle
    near = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("symbol", "row").orderBy("_d", "_t"))).filter(F.col("_r") <= k)
    if weighting == "uniform":
        w = F.lit(1.0)
    else:
        exact = F.max((F.col("_d") == 0).cast("int")).over(Window.partitionBy("symbol", "row"))
        w = F.when(exact == 1, (F.col("_d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("_d")))
    p = near.withColumn("_w", w).groupBy("symbol", "row").agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("probability"))
    return p.withColumn("label", (F.col("probability") > 0.5).cast("int"))


def nearest_centroid(points: DataFrame, centroids: list[list[float]], x: str = "x") -> DataFrame:
    """Adds cluster and distance: the nearest centroid, ties to the lower number; the centroids are an array literal."""
    each = F.array(*[F.struct(F.sqrt(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)])
    return points.withColumn("_m", F.array_min(each)).withColumn("cluster", F.col("_m.i")).withColumn("distance", F.col("_m.d")).drop("_m")
