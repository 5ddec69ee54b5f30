"""Runs many serial fits at once: a candidate is a row of model name and parameters, a task is one candidate on one series.

Parallelism is across series, candidates and folds. A series' training rows are bars, a few thousand; they are repeated
once for each candidate, as each candidate reads them all."""

from __future__ import annotations

import io
import json
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models import sequential
from tidemark.models.sequential import REGISTRY
from tidemark.runtime import ship


def candidates(spark: SparkSession, grids: dict[str, dict[str, list]]) -> DataFrame:
    """id, model, params (JSON): every combination of each model's parameters, in the order of the sorted names."""
    from itertools import product

    rows = []
    for model, grid in grids.items():
        if model not in REGISTRY:
            raise KeyError(model)
        names = sorted(grid)
        for c in product(*[grid[n] for n in names]):
            rows.append((f"{model}-{sum(r[1] == model for r in rows):03d}", model, json.dumps(dict(zip(names, c)), sort_keys=True)))
    return spark.createDataFrame(rows, "id string, model string, params string")


def make(model: str, params: str):
    return REGISTRY[model](**json.loads(params))


def _prepare(pdf: pd.DataFrame, columns: list[str], train: np.ndarray) -> np.ndarray:
    """Columns standardised by the training rows (population deviation; constant ones are 0)."""
    x = pdf[columns].to_numpy(float)
    mean, sd = x[train].mean(0), x[train].std(0)
    return np.where(sd > 1e-6, (x - mean) / np.where(sd > 1e-6, sd, 1), 0.0)


class _States(pickle.Unpickler):
    """Reads fitted models alone: their own classes and NumPy's arrays and generators. Anything else that a table's bytes may name is refused."""

    ARRAYS = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy._core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"),
              ("numpy.random._pickle", "__randomstate_ctor"), ("numpy.random._pickle", "__bit_generator_ctor"), ("numpy.random._mt19937", "MT19937")}

    def find_class(self, module, name):
        own = getattr(sequential, name, None) if module == sequential.__name__ else None
        if isinstance(own, type) and own.__module__ == module:
            return own
        if (module, name) in self.ARRAYS:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is no part of a model")


def load_state(state: bytes):
    return _States(io.BytesIO(state)).load()


PREDICTIONS = "symbol string, id string, model string, fold int, row long, part string, y int, score double, label int, reason string"


def fit_predict(d: DataFrame, chosen: DataFrame, columns: list[str], scaled: bool = True) -> DataFrame:
    """Predictions of each candidate for all rows, learnt from those of part `train`. d: symbol, row, part, y, the columns and,
    for walk-forward runs, fold. A fit that fails gives rows with a reason and no score."""
    ship(d.sparkSession)
    d = d if "fold" in d.columns else d.withColumn("fold", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        train = (pdf["part"] == "train").to_numpy()
        out = pdf[["symbol", "id", "model", "fold", "row", "part", "y"]].copy()
        out["score"], out["label"], out["reason"] = np.nan, -1, ""
        try:
            if train.sum() < 10 or len(set(pdf["y"][train])) < 2:
                raise ValueError("too few training rows or one class")
            x = _prepare(pdf, columns, train) if scaled else pdf[columns].to_numpy(float)
            m = make(pdf["model"].iloc[0], pdf["params"].iloc[0]).fit(x[train], pdf["y"].to_numpy()[train])
            out["label"] = m.predict(x).astype(int)
            out["score"] = m.score(x).astype(float) if hasattr(m, "score") else out["label"].astype(float)
        except (ValueError, np.linalg.LinAlgError) as e:
            out["reason"] = str(e)
        return out

    rows = d.select("symbol", "row", "fold", "part", F.col("y").cast("int").alias("y"), *columns).join(F.broadcast(chosen))  # the list of candidates is a parameter
    out = rows.groupBy("symbol", "id", "fold").applyInPandas(run, PREDICTIONS)
    return out.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).withColumn("label", F.when(F.col("label") >= 0, F.col("label"))).withColumn("reason", F.when(F.col("reason") != "", F.col("reason")))


def walk_forward(d: DataFrame, chosen: DataFrame, columns: list[str], folds: int = 4, first: float = 0.5, purge: int = 5) -> DataFrame:
    """Out-of-sample predictions: each fold learns from its history and predicts its block; the folds cover all rows of a symbol."""
    from tidemark.operators.splits import with_folds

    folded = with_folds(d.drop("part") if "part" in d.columns else d, folds, first, purge).withColumn("part", F.when(F.col("part") == "history", "train").otherwise("block"))
    return fit_predict(folded, chosen, columns).filter("part = 'block'")


def fit_models(d: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """symbol, id, model, params, state: fitted models, to be written as a table and read again by predict_models."""
    ship(d.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        x = pdf[columns].to_numpy(float)
        mean, sd = x.mean(0), x.std(0)
        sd = np.where(sd > 1e-6, sd, np.inf)
        m = make(pdf["model"].iloc[0], pdf["params"].iloc[0]).fit((x - mean) / sd, pdf["y"].to_numpy())
        return pd.DataFrame([(pdf["symbol"].iloc[0], pdf["id"].iloc[0], pdf["model"].iloc[0], pdf["params"].iloc[0], pickle.dumps((mean, sd, m)))], columns=["symbol", "id", "model", "params", "state"])

    rows = d.filter("part = 'train'").select("symbol", "row", F.col("y").cast("int").alias("y"), *columns).join(F.broadcast(chosen))
    return rows.groupBy("symbol", "id").applyInPandas(run, "symbol string, id string, model string, params string, state binary")


def predict_models(d: DataFrame, fitted: DataFrame, columns: list[str], more: list[str] | None = None) -> DataFrame:
    """symbol, id, row, score, label of each fitted model for its symbol's rows. more: columns that are kept and, with the
    symbol and id, say which rows are predicted together."""
    ship(d.sparkSession)
    more = list(more or [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, sd, m = load_state(pdf["state"].iloc[0])
        x = (pdf[columns].to_numpy(float) - mean) / sd
        label = m.predict(x).astype(int)
        return pd.DataFrame({"symbol": pdf["symbol"], "id": pdf["id"], "row": pdf["row"], "score": m.score(x).astype(float) if hasattr(m, "score") else label.astype(float), "label": label, **{c: pdf[c] for c in more}})

    rows = d.select("symbol", "row", *columns, *more).join(fitted.select("symbol", "id", "state"), "symbol")
    kept = "".join(f", {c} {d.schema[c].dataType.simpleString()}" for c in more)
    return rows.groupBy("symbol", "id", *more).applyInPandas(run, "symbol string, id string, row long, score double, label int" + kept)


def write_lock(selection: DataFrame, path: str) -> str:
    """Writes the selection once and returns its fingerprint; an existing lock stays."""
    rows = selection.select(F.to_json(F.struct(*sorted(selection.columns))).alias("entry"))
    rows.coalesce(1).write.mode("errorifexists").text(path)
    return lock_fingerprint(selection.sparkSession, path)


def lock_fingerprint(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("value"))), 256)).first()[0]


def evaluate_holdout(spark: SparkSession, lock: str, fingerprint: str, receipt: str, evaluate, allow_test: bool = False) -> DataFrame:
    """Runs evaluate() on the test split once: only with allow_test, only if the lock is unchanged, only if no receipt exists.
    The receipt is written with the result."""
    if not allow_test:
        raise PermissionError("the test split is closed unless allow_test is set")
    if lock_fingerprint(spark, lock) != fingerprint:
        raise ValueError("the selection lock has changed")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(receipt)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileExistsError("the test split has been read already")
    evaluate().withColumn("lock", F.lit(fingerprint)).write.mode("errorifexists").parquet(receipt)
    return spark.read.parquet(receipt)
