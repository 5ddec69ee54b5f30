"""Files that a run leaves: staged writes, manifests of snapshots, Markdown tables, guards of what may be written where.

Paths are those of Hadoop's file systems, so that they may lie on shared storage. What is written here is one small report
each; tables go through bars.write_table."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = ("source", "symbol", "date_min", "date_max", "row_count", "columns", "sha256")


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, text: str, path: str, overwrite: bool = True) -> None:
    """Writes beside the file and moves it there: readers see the old file or the whole new one."""
    fs, target = _at(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    _, staged = _at(spark, f"{path}.{uuid.uuid4().hex}")
    try:
        out = fs.create(staged, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(staged, target):
            raise OSError(f"{path} can't be replaced")
    finally:
        if fs.exists(staged):
            fs.delete(staged, False)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, value, path: str, overwrite: bool = True) -> None:
    """Strict JSON with sorted names; NaN and infinities are refused."""
    write_text(spark, json.dumps(value, sort_keys=True, indent=2, allow_nan=False) + "\n", path, overwrite)


def _cell(v) -> str:
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return "n/a"
    return f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")


def markdown(rows: list[dict], title: str, notes: tuple[str, ...] = ()) -> str:
    """A Markdown table; its header is the union of the rows' names in the order of their first appearance."""
    if not rows:
        raise ValueError("a table without rows")
    names = list(dict.fromkeys(n for r in rows for n in r))
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line(_cell(r.get(n)) for n in names) for r in rows]
    return "\n".join([f"### {title}", "", line(names), line("---" for _ in names), *body, *(["", *(f"> {n}" for n in notes)] if notes else [])]) + "\n"


def write_report(spark: SparkSession, d: DataFrame, path: str, title: str, most: int = 10_000, notes: tuple[str, ...] = ()) -> None:
    """A report of `most` rows at most as Markdown; a larger one is an error, not cut."""
    rows = d.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    write_text(spark, markdown([r.asDict() for r in rows], title, notes), path)


def make_manifest(spark: SparkSession, path: str, source: str, symbol: str, date: str = "date") -> dict:
    """What a CSV snapshot holds: columns, rows, dates and the digest of its one file."""
    d = spark.read.csv(path, header=True)
    n, first, last = d.agg(F.count("*"), F.min(date), F.max(date)).first()
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    return dict(zip(MANIFEST, (source, symbol, first, last, n, d.columns, digest)))


def read_manifest(spark: SparkSession, path: str) -> dict:
    try:
        m = json.loads(read_text(spark, path))
        return {"source": str(m["source"]), "symbol": str(m["symbol"]), "date_min": str(m["date_min"]), "date_max": str(m["date_max"]), "row_count": int(m["row_count"]), "columns": list(m["columns"]), "sha256": str(m["sha256"]).lower()}
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"no manifest in {path}: {e}") from e


def verify_snapshot(spark: SparkSession, path: str, manifest: str, date: str = "date") -> dict:
    """The manifest, if the snapshot is what it says; else an error that names each difference."""
    m = read_manifest(spark, manifest)
    now = make_manifest(spark, path, m["source"], m["symbol"], date)
    wrong = [f"{k}: {now[k]!r}, expected {m[k]!r}" for k in MANIFEST if now[k] != m[k]]
    if wrong:
        raise ValueError("; ".join(wrong))
    return m


def guard_outputs(spark: SparkSession, outputs: dict[str, str], protected: list[str], overwrite: bool = False) -> None:
    """Raises before anything is written if two outputs are one path, if an output is, holds or lies in a protected path, or if
    it exists and overwrite is unset. Links of local files are followed."""
    import os

    def full(path: str) -> str:
        fs, p = _at(spark, path)
        q = fs.makeQualified(p).toUri()
        return f"{q.getScheme()}:{os.path.realpath(q.getPath())}" if q.getScheme() == "file" else q.toString().rstrip("/")

    def same_file(a: str, b: str) -> bool:
        x, y = a.removeprefix("file:"), b.removeprefix("file:")
        return os.path.exists(x) and os.path.exists(y) and os.path.samefile(x, y)

    seen: dict[str, str] = {}
    for name, path in outputs.items():
        at = full(path)
        for other, there in seen.items():
            if at == there or same_file(at, there):
                raise ValueError(f"{name} and {other} are one file")
        for p in map(full, protected):
            if at == p or at.startswith(p + "/") or p.startswith(at + "/") or same_file(at, p):
                raise ValueError(f"{name} would write to protected {p}")
        if not overwrite and exists(spark, path):
            raise FileExistsError(path)
        seen[name] = at


def refresh(spark: SparkSession, snapshot: DataFrame, fetch, path: str) -> DataFrame:
    """Snapshot plus the newer rows of fetch(), which gives payloads as a table; written whole to `path` and read back. The bars
    of both must agree on the snapshot's dates, and the new ones hold each date once."""
    from tidemark.operators import checks
    from tidemark.operators.splits import newer_rows
    from tidemark.schema import PRICES
    from tidemark.sources.bars import differing_rows, payload_rows, write_table

    new = payload_rows(fetch()).withColumn("symbol", F.lit(snapshot.select("symbol").first()[0])).select(*snapshot.columns)
    checks.require(new.groupBy("symbol", "date").count().filter("count > 1"), "repeated dates")
    common = new.join(snapshot.select("symbol", "date"), ["symbol", "date"], "left_semi")
    known = snapshot.join(common.select("symbol", "date"), ["symbol", "date"], "left_semi")
    checks.require(differing_rows(known, common, ["symbol", "date"], list(PRICES)), "prices that differ")
    write_table(newer_rows(snapshot, new), path, overwrite=False)
    return spark.read.parquet(path)
