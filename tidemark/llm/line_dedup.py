"""Operator 9: repeated runs of lines, by distributed prefix doubling over line-ID sequences.

A text's lines become IDs (128-bit hashes). Prefix doubling refines the suffixes of all ID sequences: after round k two
suffixes are in one class if their first 2^k lines are equal, so a class is an interval of the suffix array whose longest
common prefix is 2^k lines or more. A suffix whose class has no other member is unique and leaves; the next round joins
each one left with that 2^k lines on. Only the intervals matter for deletion, not their order among each other, so classes
are named by hashes of their lines and the array is never sorted as a whole.

A run is deleted if it has `min_words` words or more and equals one that begins earlier (by doc_id, then by place), within
a text or in another. A line lies in such a run just if it lies in a window, the shortest run of min_words words forward
from some line or backward to some line, that has an earlier equal: the windows of a repeated run cover it, and equal text
has equal windows. A window of n lines, 2^k <= n < 2^(k+1), is named by the classes of its first and its last 2^k lines.
The first copy of a run stays, all later ones go.

Nulls count as empty texts. Rows that are equal in doc_id and text are one text and get the same result; a null doc_id comes
after all others. Texts that lose all lines stay as empty texts here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, release, ship, table

MIN_WORDS = 50
PLACE = ["d", "h"]


def _placed(docs: DataFrame) -> DataFrame:
    """docs with d and h, which together tell texts apart and order them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__h": F.xxhash64(text)})


def windows_of(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the length of the shortest run of `least` words that begins there, and of that which ends there; else 0."""
    n = len(words)
    sums = np.concatenate([[0], np.cumsum(words)])
    to = np.searchsorted(sums, sums[:-1] + least, side="left")
    forward = np.where(to <= n, to - np.arange(n), 0)
    back = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    return forward, np.where(sums[1:] >= least, np.arange(1, n + 1) - back, 0)


def line_table(docs: DataFrame, least: int) -> DataFrame:
    """d, h, i, name (the line's ID), forward, back: the lines of all texts with at least `least` words."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for d, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                lines = (t or b"").split(b"\n")
                words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
                if words.sum() < least:
                    continue
                forward, back = windows_of(words, least)
                n = len(lines)
                for column, values in zip(out, ([d] * n, [h] * n, range(n), [xxhash.xxh3_128_digest(x) for x in lines], forward.tolist(), back.tolist())):
                    column.extend(values)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                    out = [[], [], [], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
        release()

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    names = ["d", "h", "i", "name", "forward", "back"]
    rows = _placed(docs).select(F.col("__d").alias("d"), F.col("__h").alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "d long, h long, i int, name binary, forward int, back int")


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose class has another member. The classes are counted and written first: counting in the tasks of the join would
    bring all rows of a frequent line together, while the join alone can be split."""
    several = cut(rows.groupBy("name").count().filter("count > 1").select("name"), "names")
    return rows.join(several, "name", "left_semi")


def _later_windows(first: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """d, h, start, n of the windows of size to 2 * size - 1 lines that have an earlier equal. classes: those of size lines."""
    spans = first.select(*PLACE, F.explode(F.array(F.struct(F.col("i").alias("start"), F.col("forward").alias("n")), F.struct((F.col("i") - F.col("back") + 1).alias("start"), F.col("back").alias("n")))).alias("w"))
    spans = spans.select(*PLACE, "w.*").filter((F.col("n") >= size) & (F.col("n") < 2 * size)).distinct()
    heads = classes.select(*PLACE, F.col("i").alias("start"), F.col("name").alias("head"))
    tails = classes.select(*PLACE, F.col("i").alias("last"), F.col("name").alias("tail"))
    named = spans.join(heads, [*PLACE, "start"]).withColumn("last", F.col("start") + F.col("n") - size).join(tails, [*PLACE, "last"]).drop("last")
    named = cut(named, "windows")
    where = F.struct("d", "h", "start")
    earliest = cut(named.groupBy("head", "tail", "n").agg(F.min(where).alias("earliest"), F.count("*").alias("members")).filter("members > 1").drop("members"), "earliest")
    return named.join(earliest, ["head", "tail", "n"]).filter(where > F.col("earliest")).select(*PLACE, "start", "n")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, h, start, n: runs of lines to delete; they may overlap."""
    ship(docs.sparkSession)
    lines = cut(line_table(docs, min_words), "all-lines")
    first = cut(_repeated(lines).dropDuplicates([*PLACE, "i"]), "lines")
    drop(lines)
    longest = first.agg(F.greatest(F.max("forward"), F.max("back"))).first()[0] or 0
    classes, size, found = first.select(*PLACE, "i", "name"), 1, None
    while True:
        later = cut(_later_windows(first, classes, size), "runs")
        found = later if found is None else found.unionByName(later)
        if 2 * size > longest:
            return found
        ahead = classes.select(*PLACE, (F.col("i") - size).alias("i"), F.col("name").alias("rest"))
        doubled = cut(classes.join(ahead, [*PLACE, "i"]).select(*PLACE, "i", F.unhex(F.md5(F.concat("name", "rest"))).alias("name")), "doubled")
        after = cut(_repeated(doubled), "classes")
        drop(doubled)
        classes, size = after, 2 * size


def delete_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the kept text, and n_lines and n_removed before and after, as columns __lines and __removed."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    runs = repeated_runs(docs, min_words)
    gone = runs.groupBy("d", "h").agg(F.collect_set(F.struct("start", "n")).alias("__runs")).select(F.col("d").alias("__d"), F.col("h").alias("__h"), "__runs")
    marked = _placed(docs).join(gone, ["__d", "__h"], "left").select(*docs.columns, "__runs")
    schema = StructType([*docs.schema.fields, StructField("__lines", IntegerType()), StructField("__removed", IntegerType())])
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            kept, lines, removed = [], [], []
            for t, runs_ in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                parts = (t or "").split("\n")
                if runs_:
                    keep = np.ones(len(parts), bool)
                    for r in runs_:
                        keep[r["start"] : r["start"] + r["n"]] = False
                    t = "\n".join([p for p, k in zip(parts, keep) if k])
                    removed.append(int((~keep).sum()))
                else:
                    removed.append(0)
                kept.append(t)
                lines.append(len(parts))
            columns = list(b.columns[:-1])
            columns[at] = pa.array(kept, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int32()), pa.array(removed, pa.int32())], [*b.schema.names[:-1], "__lines", "__removed"])
        release()

    return marked.mapInArrow(run, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return delete_repeated_runs(docs).select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
