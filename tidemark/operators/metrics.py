"""Metrics of predictions, grouped by any keys. Rank metrics collapse tied scores first, so a group's curve has a row for each
distinct score; all else is one aggregation. Undefined values are null; measured() adds the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio, softplus


def regression_metrics(d: DataFrame, keys: list[str], y: str = "y", p: str = "prediction") -> DataFrame:
    e = F.col(y) - F.col(p)
    # the sum of squares about the mean comes from the population variance, which is stable
    r = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("_v"), F.count_if(F.col(p) < 0).alias("n_negative"))
    return r.select(*keys, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), F.when((F.col("n") > 1) & (F.col("_v") > 0), 1 - F.col("mse") / F.col("_v")).alias("r2"), "n_negative")


def confusion_metrics(d: DataFrame, keys: list[str], y: str = "y", label: str = "label") -> DataFrame:
    a, b = F.col(y) == 1, F.col(label) == 1
    r = d.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"), F.count_if(~a & ~b).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return r.withColumns({"accuracy": ratio(tp + tn, F.col("n")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def ranked(d: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """One row for each distinct score, highest first, with counts and cumulative counts of both classes."""
    g = d.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc()) if keys else Window.orderBy(F.col("score").desc())
    down, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    return g.withColumns({"cum_pos": F.sum("pos").over(down), "cum_neg": F.sum("neg").over(down), "all_pos": F.sum("pos").over(whole), "all_neg": F.sum("neg").over(whole)})


def rank_metrics(d: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """roc_auc by trapezoids, average_precision by steps; null with one class only."""
    r = ranked(d, keys, y, score)
    area = F.sum(F.col("neg") * (2 * F.col("cum_pos") - F.col("pos")))
    step = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    a = r.groupBy(*keys).agg(area.alias("_a"), step.alias("_s"), F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return a.select(*keys, "n_pos", "n_neg", F.when(both, F.col("_a") / (2 * F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"), F.when(both, F.col("_s") / F.col("n_pos")).alias("average_precision"))


def roc_curve(d: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    return ranked(d, keys, y, score).select(*keys, "score", ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"), ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"))


def precision_recall_curve(d: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    return ranked(d, keys, y, score).select(*keys, "score", ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"), ratio(F.col("cum_pos"), F.col("all_pos")).alias("recall"))


def select_threshold(d: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """The score from which on predictions are 1: best F1, then best recall, then the lower score."""
    r = ranked(d, keys, y, score)
    f1 = ratio(2 * F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg") + F.col("all_pos"))
    recall = ratio(F.col("cum_pos"), F.col("all_pos"))
    best = r.filter(F.col("all_pos") > 0).groupBy(*keys).agg(F.max(F.struct(f1.alias("f1"), recall.alias("recall"), (-F.col("score")).alias("m"))).alias("b"))
    return best.select(*keys, (-F.col("b.m")).alias("threshold"), F.col("b.f1").alias("f1"), F.col("b.recall").alias("recall"))


def loss(name: str, y: Column, z: Column) -> Column:
    """Mean loss of a score: bce takes a probability, the others a margin's score."""
    margin = (2 * y - 1) * z
    if name == "bce":
        p = F.least(F.greatest(z, F.lit(1e-15)), F.lit(1 - 1e-15))
        return F.avg(-(y * F.log(p) + (1 - y) * F.log1p(-p)))
    each = {"logistic": lambda: softplus(-margin), "hinge": lambda: F.greatest(F.lit(0.0), 1 - margin), "perceptron": lambda: F.greatest(F.lit(0.0), -margin), "mistakes": lambda: (margin <= 0).cast("double"), "exponential": lambda: F.exp(-margin)}
    return F.avg(each[name]())


def select_candidate(d: DataFrame, task: str, keys: list[str]) -> DataFrame:
    """The best candidate of each group: least rmse, mae; highest average_precision, roc_auc; highest silhouette. Ties go to
    the smaller id; candidates without the first metric don't take part."""
    order = {"regression": [F.asc("rmse"), F.asc_nulls_last("mae")], "classification": [F.desc("average_precision"), F.desc_nulls_last("roc_auc")], "clustering": [F.desc("silhouette")]}[task]
    first = {"regression": "rmse", "classification": "average_precision", "clustering": "silhouette"}[task]
    w = Window.partitionBy(*keys).orderBy(*order, F.asc("id"))
    return d.filter(F.col(first).isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def qlike(d: DataFrame, keys: list[str], y: str = "y", p: str = "prediction") -> DataFrame:
    r = F.pow(ratio(F.col(y), F.col(p)), 2)
    return d.groupBy(*keys).agg(F.when(F.min(p) > 0, F.avg(r - F.log(r) - 1)).alias("qlike"))


def spearman(d: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Correlation of ranks; ties share their mean rank."""

    def rank(c: str) -> Column:
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2

    r = d.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_ra", rank(a)).withColumn("_rb", rank(b))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def clustering_metrics(points: DataFrame, keys: list[str], x: str = "x", cluster: str = "cluster") -> DataFrame:
    """n, clusters, inertia and mean silhouette. points: an id, an array of coordinates, a cluster; for evaluation sets of a few
    thousand points per group, as distances between all points of a group are what a silhouette is."""
    sums = points.select(*keys, cluster, F.posexplode(x).alias("dim", "v")).groupBy(*keys, cluster, "dim").agg(F.avg("v").alias("c"), F.var_pop("v").alias("var"), F.count("*").alias("n"))
    inertia = sums.groupBy(*keys).agg(F.sum(F.col("var") * F.col("n")).alias("inertia"))
    a, b = points.select(*keys, F.col("id").alias("i"), F.col(x).alias("xi"), F.col(cluster).alias("ci")), points.select(*keys, F.col("id").alias("j"), F.col(x).alias("xj"), F.col(cluster).alias("cj"))
    square = F.aggregate(F.zip_with("xi", "xj", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    to = a.join(b, keys).filter("i <> j").groupBy(*keys, "i", "ci", "cj").agg(F.avg(F.sqrt(square)).alias("d"))
    s = to.groupBy(*keys, "i", "ci").agg(F.min(F.when(F.col("cj") == F.col("ci"), F.col("d"))).alias("own"), F.min(F.when(F.col("cj") != F.col("ci"), F.col("d"))).alias("other"))
    s = s.withColumn("s", F.when(F.col("own").isNull(), 0.0).otherwise(ratio(F.col("other") - F.col("own"), F.greatest("other", "own"))))
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(cluster).alias("k"))
    out = sizes.join(inertia, keys).join(s.groupBy(*keys).agg(F.avg("s").alias("_s")), keys, "left")
    return out.select(*keys, "n", "k", "inertia", F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), F.col("_s")).alias("silhouette"))


def cluster_labels(d: DataFrame, keys: list[str], cluster: str = "cluster", y: str = "y") -> DataFrame:
    """Each cluster's majority label, 1 on a tie; d holds training rows."""
    return d.groupBy(*keys, cluster).agg(F.avg(y).alias("share"), (F.avg(y) >= 0.5).cast("int").alias("label"))


def align_clusters(d: DataFrame, a: str, b: str) -> DataFrame:
    """For each cluster of b the cluster of a that it overlaps most; ties go to the lower name."""
    n = d.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.groupBy(b).agg(F.max_by(a, F.struct("n", (-F.col(a)).alias("m"))).alias("as"))


def baselines(d: DataFrame, target: str, label: str, persistence: str) -> DataFrame:
    """Rows with the predictions of three baselines: training mean, training majority, persistence. d has split, threshold."""
    train = d.filter(F.col("split") == "train").groupBy("symbol").agg(F.avg(target).alias("mean_baseline"), (F.avg(label) >= 0.5).cast("int").alias("majority_baseline"))
    return d.join(train, "symbol").withColumn("persistence_baseline", F.col(persistence)).withColumn("persistence_label", (F.col(persistence) > F.col("threshold")).cast("int"))


def clipped_metrics(d: DataFrame, keys: list[str], y: str = "y", p: str = "prediction") -> DataFrame:
    """Metrics of the predictions and of the same raised to zero where they are negative."""
    raw = regression_metrics(d, keys, y, p)
    clipped = regression_metrics(d.withColumn(p, F.greatest(F.col(p), F.lit(0.0))), keys, y, p).drop("n", "n_negative")
    return raw.join(clipped.select(*keys, *[F.col(c).alias(f"clipped_{c}") for c in clipped.columns if c not in keys]), keys)


def half_vote(probability: Column, total: Column) -> Column:
    """A quarter of the log odds times the votes' total: half the margin of boosted votes."""
    return F.log(probability / (1 - probability)) * total / 4
