"""Models against closed forms, other derivations and separable data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.models import grid, native
from tidemark.models.sequential import REGISTRY, AdaBoost, Agglomerative, GradientBoosting, KMeans, Neighbours, SecondOrderBoosting, Tree, stopping_split


@pytest.fixture(scope="module")
def data():
    """Two overlapping clouds in four columns, of which one says nothing."""
    r = np.random.default_rng(8)
    y = (np.arange(180) * 7 % 5 < 2).astype(int)
    x = r.uniform(-1, 1, (180, 4)) + np.outer(y, [1.1, -0.9, 0.7, 0.0])
    return x, y


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in ("kmeans", "agglomerative")])
def test_classifiers_learn(data, name):
    x, y = data
    m = REGISTRY[name](**{"svm": {"rounds": 2000}, "kernel_perceptron": {"gamma": 0.1}}.get(name, {})).fit(x[:120], y[:120])
    assert (m.predict(x[120:]) == y[120:]).mean() > 0.7
    assert np.isfinite(m.score(x)).all()


def test_hand_calculations():
    x, y = np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0, 0, 1, 1])
    assert Tree(1).fit(x, y.astype(float)).nodes[0][:2] == (0, 1.5)
    one = SecondOrderBoosting(trees=1, rate=1.0, depth=1, penalty=1.0, least_curvature=0.0).fit(x, y)
    assert one.stages[0][2:] == pytest.approx((-1 / 1.5, 1 / 1.5))
    g = GradientBoosting(trees=1, rate=1.0, depth=1).fit(x, y)
    assert g.margin(x) == pytest.approx([-2, -2, 2, 2])
    assert AdaBoost(5).fit(x, y).predict(x).tolist() == [0, 0, 1, 1]
    n = Neighbours(2, "distance").fit(x, y)
    assert n.score(np.array([[1.0], [1.5]])) == pytest.approx([0.0, 0.5])
    assert [len(a) for a in stopping_split(100)] == [80, 15]


def test_clusters():
    x = np.vstack([np.random.RandomState(0).randn(20, 2), np.random.RandomState(1).randn(20, 2) + 10])
    for m in (KMeans(2), Agglomerative(2), Agglomerative(2, "average")):
        label = m.fit(x).predict(x)
        assert len(set(label[:20])) == 1 and len(set(label[20:])) == 1 and label[0] != label[-1]


def table(spark, n=80):
    r = np.random.RandomState(3)
    x = r.randn(n, 3)
    y = 1 + x @ [0.5, -1, 2] + 0.1 * r.randn(n)
    rows = [("a", i, "train", *map(float, x[i]), float(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "symbol string, row long, split string, a double, b double, c double, y double")


def test_linear_fits(spark):
    x, y, d = table(spark)
    z = np.column_stack([np.ones(len(x)), x])
    w = np.linalg.lstsq(z, y, rcond=None)[0]
    got = native.fit_least_squares(d, ["a", "b", "c"], "y").first()
    assert [got.intercept, *got.weights] == pytest.approx(w.tolist())
    plain = native.fit_elastic_net(d, ["a", "b", "c"], "y", 0.0, 0.5).first()
    assert plain.weights == pytest.approx(got.weights, abs=1e-6)
    e = native.fit_elastic_net(d, ["a", "b", "c"], "y", 0.2, 0.5).first()
    residual = y - e.intercept - x @ e.weights
    grad = x.T @ residual / len(y) - 0.1 * np.array(e.weights)
    assert np.abs(grad - 0.1 * np.sign(e.weights)).max() < 1e-6
    assert native.fit_ridge_to_prior(d, ["a"], "y", float("inf"), [0.7]).first().weights == [0.7]
    assert native.pooled_prior(d, ["a", "b", "c"], "y") == pytest.approx(got.weights)


def test_components_match_numpy(spark):
    x, _, d = table(spark)
    rows = native.fit_pca(d, ["a", "b", "c"], 2).orderBy("component").collect()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r.variance for r in rows] == pytest.approx(values[:2].tolist())
    assert all(max(r.weights, key=abs) > 0 for r in rows)


def test_constant_column_scales_to_zero(spark):
    d = spark.createDataFrame([("a", "train", 1.0, 5.0), ("a", "train", 3.0, 5.0)], "symbol string, split string, x double, c double")
    assert sorted(tuple(r) for r in native.scale(d, native.fit_scaler(d, ["x", "c"]), ["x", "c"]).select("x", "c").collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_saved_models_predict_alike(spark):
    _, y, d = table(spark)
    d = d.withColumn("y", (F.col("y") > 1).cast("int")).withColumn("part", F.lit("train"))
    chosen = grid.candidates(spark, {"decision_tree": {"depth": [2]}, "logistic": {"rounds": [200]}})
    direct = grid.fit_predict(d, chosen, ["a", "b", "c"])
    again = grid.predict_models(d, grid.fit_models(d, chosen, ["a", "b", "c"]), ["a", "b", "c"])
    j = direct.join(again.select("symbol", "id", "row", F.col("score").alias("s2"), F.col("label").alias("l2")), ["symbol", "id", "row"])
    assert j.count() == 160 and j.filter("abs(score - s2) > 1e-9 or label <> l2").count() == 0


def test_holdout_opens_once(spark, tmp_path):
    selection = spark.createDataFrame([("logistic", 0.1)], "model string, value double")
    lock, receipt = str(tmp_path / "lock"), str(tmp_path / "receipt")
    mark = grid.write_lock(selection, lock)
    evaluate = lambda: selection.withColumn("test", F.lit(1.0))
    with pytest.raises(PermissionError):
        grid.evaluate_holdout(spark, lock, mark, receipt, evaluate)
    with pytest.raises(ValueError):
        grid.evaluate_holdout(spark, lock, "other", receipt, evaluate, True)
    assert grid.evaluate_holdout(spark, lock, mark, receipt, evaluate, True).count() == 1
    with pytest.raises(FileExistsError):
        grid.evaluate_holdout(spark, lock, mark, receipt, evaluate, True)


def test_gradients_match_differences():
    from tidemark.models.sequence import Encoder, bce_with_logits, masked_mse

    r = np.random.RandomState(0)
    x, y = r.randn(3, 4, 2), np.array([0.0, 1.0, 1.0])
    for kind in ("gru", "transformer"):
        e = Encoder(kind, 2, 4, width=4, layers=1, heads=2, rate=0.0, seed=1)
        for loss in (lambda: bce_with_logits(e.logits(x), y, np.ones(3)), lambda: masked_mse(e(x) @ e.p["out"] + e.p["out_b"], x, np.ones_like(x))):  # noqa: B023
            for v in e.p.values():
                v.grad = None
            out = loss()
            out.backward()
            grads = {k: v.grad.copy() for k, v in e.p.items() if v.grad is not None}
            for k, g in grads.items():
                at = tuple(r.randint(n) for n in g.shape)
                v, old = e.p[k], e.p[k].data[at]
                v.data[at] = old + 1e-6
                up = float(loss().data)
                v.data[at] = old - 1e-6
                down = float(loss().data)
                v.data[at] = old
                assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6), (kind, k)


def test_sequence_models_learn():
    from tidemark.models.sequence import Encoder, average_precision, finetune, pretrain

    r = np.random.RandomState(2)
    x = r.randn(160, 6, 2)
    y = (x[:, -1, 0] > 0).astype(float)
    e = Encoder("gru", 2, 6, width=8, layers=1, seed=0)
    losses = pretrain(e, x, 4)
    assert losses[-1] < losses[0]
    finetune(e, x, y, 25)
    assert average_precision(y, e.logits(x).data) > 0.9


def test_all_rows_get_a_cluster(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # whose series are longer than any prefix once taken
    from tidemark.plans import catalog

    rows = {r.symbol: r["count"] for r in catalog.modeling_table(spark, sf_dir).groupBy("symbol").count().collect()}
    assert max(rows.values()) > 150
    got = catalog.agglomerative_clusters(spark, sf_dir).groupBy("symbol", "id").agg(F.sum("n_rows").alias("n"), F.count("label").alias("k")).collect()
    assert len(got) == 2 * len(rows) and all(r.n == rows[r.symbol] and r.k == 2 for r in got)


def test_every_feature_is_permuted_in_every_repeat(spark, sf_dir):
    from tidemark.plans import catalog

    scores = catalog.permuted_scores(spark, sf_dir.replace("sf0.001", "sf0.01"))[1].cache()
    symbols = scores.select("symbol").distinct().count()
    assert symbols and scores.count() == symbols * 8 * 30 == scores.select("symbol", "feature", "repeat").distinct().count()
    assert {r.feature for r in scores.select("feature").distinct().collect()} == set(catalog.X)
    assert catalog.permutation_importance(spark, sf_dir.replace("sf0.001", "sf0.01")).count() == symbols * 8


def test_extra_columns_of_predictions_keep_rows_apart(spark):
    x = ["a", "b", "c"]
    d = table(spark)[2].select("symbol", "row", F.col("split").alias("part"), F.expr("int(y > 1)").alias("y"), *x)
    fitted = grid.fit_models(d, grid.candidates(spark, {"logistic": {"rounds": [50]}}), x)
    plain = {r.row: r.score for r in grid.predict_models(d, fitted, x).collect()}
    twice = d.withColumn("a", F.col("a") * 0).withColumn("repeat", F.lit(1)).unionByName(d.withColumn("repeat", F.lit(0)))
    got = grid.predict_models(twice, fitted, x, ["repeat"]).collect()
    assert len(got) == 2 * len(plain) and all(r.score == plain[r.row] for r in got if r.repeat == 0)
    assert any(r.score != plain[r.row] for r in got if r.repeat == 1)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_states_of_all_models_are_read_back(name):
    import pickle

    r = np.random.default_rng(5)
    x = r.normal(size=(60, 3))
    y = (x[:, 0] - x[:, 2] > 0).astype(int)
    m = grid.make(name, "{}").fit(x, y)
    assert np.array_equal(grid.load_state(pickle.dumps((x, 1.5, m)))[2].predict(x), m.predict(x))


@pytest.mark.parametrize("state", [b"cos\nsystem\n(S'true'\ntR.", b"ctidemark.models.sequential\nnp.load\n.", b"cbuiltins\neval\n."])
def test_states_that_name_anything_else_are_refused(state):
    import pickle

    with pytest.raises(pickle.UnpicklingError):
        grid.load_state(state)
