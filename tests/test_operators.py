"""Operators on small frames: hand calculations, boundaries, causality, refusals."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, features, metrics, resample, spikes, splits
from tidemark.sources import bars


def frame(spark, n=60, close=None, volume=None, scale_after=None):
    rows = []
    for i in range(n):
        c = close(i) if close else 40 + 7 * ((i * i) % 11) / 10 + i / 8
        v = volume(i) if volume else 300.0 + (i * 37) % 101
        if scale_after is not None and i > scale_after:
            c, v = 10 * c, 10 * v
        rows.append(("a", datetime.date(2019, 3, 4) + datetime.timedelta(days=i), float(c), 1.01 * c, 0.98 * c, float(c), float(v)))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def column(d, name):
    return [r[0] for r in d.orderBy("date").select(name).collect()]


def test_first_valid_places(spark):
    d = features.add_target(features.add_features(frame(spark)))
    first = {c: next(i for i, x in enumerate(column(d, c)) if x is not None) for c in ("return_1d", "return_5d", "volatility_5d", "volatility_20d", "intraday_range", "sma_ratio_5_20", "rsi_14", "volume_zscore_20")}
    assert first == {"return_1d": 1, "return_5d": 5, "volatility_5d": 5, "volatility_20d": 20, "intraday_range": 0, "sma_ratio_5_20": 19, "rsi_14": 14, "volume_zscore_20": 19}
    assert column(d, "target_volatility_5d")[-5:] == [None] * 5 and column(d, "target_volatility_5d")[-6] is not None


def test_features_do_not_see_the_future(spark):
    a, b = features.add_features(frame(spark)), features.add_features(frame(spark, scale_after=39))
    for c in ("return_5d", "volatility_20d", "rsi_14", "volume_zscore_20"):
        assert column(a, c)[:40] == column(b, c)[:40]


def test_wilder_equals_the_loop_over_many_blocks(spark):
    x = np.random.RandomState(1).rand(5000)
    rows = [("a", i, i, float(v)) for i, v in enumerate(x)]
    d = features.wilder(spark.createDataFrame(rows, "symbol string, date int, pos int, x double"), "x", "y", 14)
    want = [None] * 14 + [x[1:15].mean()]
    for v in x[15:]:
        want.append((want[-1] * 13 + v) / 14)
    got = column(d, "y")
    assert got[:14] == want[:14]
    assert np.allclose(got[14:], want[14:], rtol=1e-12)


@pytest.mark.parametrize(("close", "want"), [(lambda i: 100, 50.0), (lambda i: 100 + i, 100.0), (lambda i: 200 - i, 0.0)])
def test_strength_at_its_edges(spark, close, want):
    assert set(column(features.add_features(frame(spark, 20, close)), "rsi_14")[14:]) == {want}


def test_constant_volume_has_no_score_and_short_series_no_strength(spark):
    assert set(column(features.add_features(frame(spark, 30, volume=lambda i: 5)), "volume_zscore_20")) == {None}
    assert set(column(features.add_features(frame(spark, 14)), "rsi_14")) == {None}


def test_split_arithmetic(spark):
    d = splits.chronological_split(spark.range(2487).select(F.lit("a").alias("symbol"), F.col("id").alias("date")))
    assert {r.split: r.n for r in d.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 1733, "validation": 371, "test": 373, "gap1": 5, "gap2": 5}
    with pytest.raises(ValueError):
        splits.chronological_split(d, 0.7, 0.2, 0.2)
    with pytest.raises(PermissionError):
        splits.named_dataset(d, "test")


def test_label_is_strict(spark):
    d = spark.createDataFrame([("a", 1, "train", 1.0), ("a", 2, "train", 2.0), ("a", 3, "train", 3.0)], "symbol string, date int, split string, target_volatility_5d double")
    d = splits.with_label(d, d.select("symbol", F.lit(2.0).alias("threshold")).distinct())
    assert column(d, "target_high_volatility") == [0, 0, 1]


def test_affected_rows_are_clipped_to_their_split(spark):
    rows = [("a", i, "train" if i < 30 else "test", i in (0, 28)) for i in range(40)]
    d = spikes.coverage(spark.createDataFrame(rows, "symbol string, date int, split string, is_spike boolean"))
    assert [i for i, x in enumerate(column(d, "is_spike_affected")) if x] == [*range(20), *range(23, 30)]
    w = {r.date: (r.from_row, r.to_row, r.cut_left, r.cut_right) for r in spikes.affected_windows(d).collect()}
    assert w == {0: (0, 19, True, False), 28: (23, 29, False, True)}


def test_cleaning_rules(spark):
    rows = [
        ("a", "2024-01-01", "1", "2", "0.5", "1.5", "10"), ("a", "1/2/2024", "1", "2", "0.5", "1.5", "0"), ("a", "bad", "1", "2", "0.5", "1.5", "10"), ("a", "2024-01-01", "1", "2", "0.5", "1.5", "10"),
        ("a", "2024-01-03", "x", "2", "0.5", "1.5", "10"), ("a", "2024-01-04", "0", "2", "0.5", "1.5", "10"), ("a", "2024-01-05", "3", "2", "0.5", "1.5", "10"), ("a", "2024-01-06", "1", "2", "0.5", "9", "10"), ("a", "2024-01-07", "1", "2", "0.5", "1.5", "-1"),
    ]
    raw = spark.createDataFrame(rows, "symbol string, date string, open string, high string, low string, close string, volume string")
    r = clean.cleaning_report(clean.mark_rows(raw)).first()
    assert (r.rows_before, r.rows_after, r.zero_volume, r.nonnumeric_open) == (9, 3, 1, 1)
    assert [r[x] for x in clean.RULES] == [1, 1, 0, 1, 1, 1, 1]
    assert clean.clean(raw).count() == 3
    twice = raw.unionByName(spark.createDataFrame([("a", "2024-01-01", "1", "2", "0.5", "1.6", "10")], raw.schema))
    with pytest.raises(ValueError, match="2024-01-01"):
        clean.clean(twice)


def test_rank_metrics_with_ties_and_one_class(spark):
    d = spark.createDataFrame([("k", 1, 0.9), ("k", 0, 0.9), ("k", 1, 0.5), ("k", 0, 0.1), ("one", 1, 0.3)], "g string, y int, score double")
    got = {r.g: r for r in metrics.rank_metrics(d, ["g"]).collect()}
    assert got["k"].roc_auc == pytest.approx(0.625) and got["k"].average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert got["one"].roc_auc is None


def test_block_indices(spark):
    a = resample.block_indices(50, 20, 7)
    assert a.shape == (7, 50) and a.min() >= 0 and a.max() < 50
    assert (np.diff(a[:, :20], axis=1) == 1).all()
    assert resample.index_table(spark, a).count() == 350
    d = spark.createDataFrame([("s", i, 1.0) for i in range(20)], "symbol string, replicate int, v double")
    assert resample.difference(d, d, ["symbol"], "v").first().low == 0


def test_block_permutation_keeps_the_values(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(47)], "symbol string, row int, x double")
    p = resample.block_permutation(d, ["symbol"], "x", 2)
    assert sorted(r.x for r in p.filter("repeat = 1").collect()) == [float(i) for i in range(47)]


def test_sources(spark, tmp_path):
    d = frame(spark, 5).drop("symbol")
    bars.write_table(d, str(tmp_path / "c"), format="csv")
    raw = bars.read_csv(spark, str(tmp_path / "c"))
    assert bars.normalize_rows(raw).orderBy("date").first().close == 40.0  # the first close of frame()
    with pytest.raises(Exception, match="exist"):
        bars.write_table(d, str(tmp_path / "c"), format="csv")
    with pytest.raises(ValueError, match="missing"):
        bars.read_csv(spark, str(tmp_path / "c"), ("nothing",))
    assert bars.file_hashes(spark, str(tmp_path / "c")).count() >= 1
    p = bars.profile(frame(spark, 5))
    assert bars.same_profile(p, bars.profile(frame(spark, 5))) and not bars.same_profile(p, bars.profile(frame(spark, 6)))
    odd = spark.createDataFrame([("$1,234.50", "3/4/2024"), ("x", "2024-13-01")], "n string, d string")
    from tidemark.functions.scalar import any_date, plain_number

    assert [tuple(r) for r in odd.select(plain_number(F.col("n")), any_date(F.col("d"))).collect()] == [(1234.5, datetime.date(2024, 3, 4)), (None, None)]


def test_positions_and_newer_rows(spark):
    line = frame(spark, 10).select("symbol", "date")
    assert splits.positions_on(line, line.filter("day(date) = 7")).first().position == 3
    with pytest.raises(ValueError):
        splits.positions_on(line.filter("day(date) > 7"), line)
    assert splits.newer_rows(line.filter("day(date) <= 7"), line).count() == 10
    assert splits.expand_grid(spark, {"b": [1, 2], "a": ["x"]}).count() == 2


def test_folds_cover_all_rows_as_the_plan_says(spark):
    d = spark.createDataFrame([("a", i) for i in range(103)] + [("b", i) for i in range(40)], "symbol string, row int")
    got = {}
    for r in splits.with_folds(d).collect():
        got.setdefault((r.symbol, r.fold, r.part), []).append(r.row)
    for symbol, n in (("a", 103), ("b", 40)):
        for k, until, start, stop in splits.fold_plan(n):
            assert sorted(got[symbol, k, "history"]) == list(range(until)) and sorted(got[symbol, k, "block"]) == list(range(start, stop))
        assert splits.fold_plan(n)[-1][3] == n
