"""Checks and run files on small frames."""

import datetime
import json
import os

import pytest

from tidemark.operators import checks
from tidemark.sources import artifacts

D = [datetime.date(2020, 1, i) for i in range(1, 9)]


def runs(spark, rows):
    return spark.createDataFrame([("a", D[i], t, p) for i, t, p in rows], "symbol string, date date, target double, prediction double")


def test_misaligned(spark):
    a, b = runs(spark, [(0, 1.0, 0.0), (1, 2.0, 0.0), (2, None, 0.0), (3, 4.0, 0.0)]), runs(spark, [(1, 2.0, 0.5), (2, None, 0.5), (3, 4.5, 0.5), (4, 5.0, 0.5)])
    found = checks.misaligned(a, b, ["symbol", "date"], "target")
    assert {(r.date, r.reason) for r in found.collect()} == {(D[0], "only_first"), (D[3], "target"), (D[4], "only_second")}
    with pytest.raises(ValueError, match="runs"):
        checks.require(found, "runs")
    checks.require(checks.misaligned(a, a, ["symbol", "date"], "target"), "runs")


def test_paired_and_parity(spark):
    d = runs(spark, [(0, 1.0, None), (1, float("nan"), 1.0), (2, 1.0, float("-inf")), (3, 1.0, 1.0)])
    assert checks.paired_violations(d, ["symbol"], "target", "prediction").collect()[0][1:] == (4, 1, 2)
    a, b = runs(spark, [(0, 0.0, 1.0), (1, 0.0, 2.0)]), runs(spark, [(0, 0.0, 1.0 + 1e-9), (1, 0.0, 2.1)])
    r = checks.parity(a, b, ["symbol", "date"], ["symbol"], "prediction").first()
    assert (r.n, r.n_differ, r.same) == (2, 1, False) and r.largest == pytest.approx(0.1)
    assert checks.parity(a, a, ["symbol", "date"], ["symbol"], "prediction", exact=True).first().same


def test_split_contract_sees_faults(spark):
    rows = [("train", 0, 0), ("train", 1, 1), ("gap1", 2, 2), ("validation", 4, 3), ("validation", 6, 4), ("gap2", 7, 3), ("test", 8, 7)]
    d = spark.createDataFrame([("a", s, r, D[i]) for s, r, i in rows], "symbol string, split string, row long, date date")
    got = {r.split: (r.contiguous, r.follows, r.later, r.gap_ok) for r in checks.split_contract(d, gap=1).collect()}
    assert got == {"train": (True, True, True, True), "gap1": (True, True, True, True), "validation": (False, False, True, True), "gap2": (True, True, False, True), "test": (True, True, True, True)}
    assert not [r for r in checks.split_contract(d, gap=2).collect() if r.split.startswith("gap") and r.gap_ok]


def test_files(spark, tmp_path):
    path = str(tmp_path / "r.json")
    artifacts.write_json(spark, {"b": 1, "a": [1.5, None]}, path)
    artifacts.write_json(spark, {"b": 2}, path)
    assert json.loads(artifacts.read_text(spark, path)) == {"b": 2} and [x for x in os.listdir(tmp_path) if not x.startswith(".")] == ["r.json"]
    with pytest.raises(FileExistsError):
        artifacts.write_json(spark, {}, path, overwrite=False)
    with pytest.raises(ValueError):
        artifacts.write_json(spark, float("nan"), path)
    text = artifacts.markdown([{"model": "m|1", "v": 0.5}, {"model": "n", "reason": None}], "T", ("note",))
    assert text.splitlines()[2:6] == ["| model | v | reason |", "| --- | --- | --- |", "| m\\|1 | 0.5000 | n/a |", "| n | n/a | n/a |"]
    with pytest.raises(ValueError):
        artifacts.write_report(spark, spark.range(3), path, "T", most=2)


def test_manifest(spark, tmp_path):
    data, manifest = str(tmp_path / "s.csv"), str(tmp_path / "m.json")
    open(data, "w").write("date,close\n2020-01-01,1\n2020-01-02,2\n")
    artifacts.write_json(spark, artifacts.make_manifest(spark, data, "x", "a"), manifest)
    assert artifacts.verify_snapshot(spark, data, manifest)["row_count"] == 2
    open(data, "a").write("2020-01-03,3\n")
    with pytest.raises(ValueError, match="row_count"):
        artifacts.verify_snapshot(spark, data, manifest)
    artifacts.write_json(spark, {"source": "x"}, manifest)
    with pytest.raises(ValueError, match="no manifest"):
        artifacts.read_manifest(spark, manifest)


def test_guards(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "s.csv").write_text("x")
    os.symlink(raw / "s.csv", tmp_path / "link")
    os.link(raw / "s.csv", tmp_path / "hard")
    ok = {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}
    artifacts.guard_outputs(spark, ok, [str(raw)])
    for bad in ({"a": ok["a"], "b": ok["a"]}, {"a": str(raw / "new")}, {"a": str(tmp_path / "link")}, {"a": str(tmp_path)}):
        with pytest.raises(ValueError):
            artifacts.guard_outputs(spark, bad, [str(raw)], overwrite=True)
    with pytest.raises(ValueError):
        artifacts.guard_outputs(spark, {"a": str(tmp_path / "hard")}, [str(raw / "s.csv")], overwrite=True)
    (tmp_path / "a").write_text("x")
    with pytest.raises(FileExistsError):
        artifacts.guard_outputs(spark, ok, [str(raw)])


def test_refresh(spark, tmp_path):
    old = spark.createDataFrame([("q", D[0], 1.0, 2.0, 1.0, 2.0, 5.0), ("q", D[1], 2.0, 3.0, 1.0, 2.0, 5.0)], "symbol string, date date, open double, high double, low double, close double, volume double")

    def payload(close):
        rows = [{"date": f"01/0{i}/2020", "open": "$2", "high": "$3", "low": "$1", "close": c, "volume": "5"} for i, c in ((2, close), (3, "$2.5"))]
        return lambda: spark.createDataFrame([(json.dumps({"status": {"rCode": 200}, "data": {"rows": rows}}),)], "payload string")

    out = artifacts.refresh(spark, old, payload("$2"), str(tmp_path / "new"))
    assert [(r.date, r.close) for r in out.orderBy("date").collect()] == [(D[0], 2.0), (D[1], 2.0), (D[2], 2.5)]
    with pytest.raises(ValueError, match="differ"):
        artifacts.refresh(spark, old, payload("$9"), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()
