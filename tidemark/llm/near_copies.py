"""Near copies by wide SimHash fingerprints: the generalised pigeonhole of `simhash` for a similarity instead of a radius.

A text's fingerprint is the SimHash of its set of distinct word shingles, `WORDS` words of 64 bits from independent bits of
the shingles' hashes. Sets of Jaccard similarity J differ in a bit with the chance acos(2J / (1 + J)) / pi, whatever the
texts are. The correlated bits of each word are grouped into parts; a part with threshold t finds a pair if its values
differ in t bits at most. A dynamic program allots the thresholds, unequally and -1 where a part isn't probed, such that
the estimated number of probes and candidates is least while pairs of similarity `least` are missed with a chance of
1 - `recall` at most. Candidates are verified twice: by their fingerprints, of which members of small buckets carry CHECKED words and others all,
and by their shingles: the Jaccard similarity is exact where both texts have at most SKETCH distinct shingles, else estimated
from the smallest SKETCH ones. A pair that several parts find is taken from the first of those that lie in the words carried.

The members of a hot bucket are compared with its first ones, its pivots; what is in one group then isn't paired, only members
of different groups are. Where a bucket of more than LARGE_BUCKET texts has such members, it is divided by runs of eight
further bits, and so on. What is still large after the last division is dealt out by salt and compared in full.

Nulls count as empty texts; texts without words are one text, and so are rows of equal text.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import acos, comb, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, mix, raw_texts, release, ship
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import BITS, LEAST_PLANNED, PROBE, as_long, bit_counts, flips, group_bits, mask, shingle_hashes

WORDS, SKETCH = 16, 512
CHECKED, DEVIATIONS = 2, 2.0
#: A bucket is hot if it has more texts than this and than HOT_FACTOR times the mean.
HOT_BUCKET, HOT_FACTOR, LARGE_BUCKET, PIVOTS, LEVELS, RUNS, SALTS = 16, 8, 8192, 2, 3, 12, 16
#: Cost of checking one candidate against that of one probe.
CANDIDATE = 0.05
#: How far an estimated similarity may lie below the least one.
SLACK = 0.01
_SALT = mix(np.arange(1, WORDS + 1, dtype=np.uint64))


def differing(similarity: float) -> float:
    """Chance that a bit of two sets' fingerprints differs."""
    return acos(2 * similarity / (1 + similarity)) / pi


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """WORDS words of a set of hashes: a bit is 1 if over half of the mixed hashes have it."""
    counts = np.zeros(WORDS * BITS, np.int64)
    for at in range(0, len(h), 255):
        x = (h[at : at + 255, None] ^ _SALT) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        counts += bit_counts(x)
    return np.packbits(counts * 2 > len(h)).view(">u8").astype(np.uint64).view(np.int64)


def wide_prints(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h, w (the words), n (distinct shingles) and sketch of rows with doc_id, h and text."""

    def run(batches):
        for b in batches:
            words, sizes, sketches = [], [], []
            for t in raw_texts(b):
                parts = list(shingle_hashes(t, shingle))
                h = np.unique(mix(np.concatenate(parts))) if parts else np.zeros(0, np.uint64)
                words.append(wide_fingerprint(h))
                sizes.append(len(h))
                sketches.append((h[:SKETCH] >> np.uint64(33)).astype(np.int32))  # in the same order
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int32()))], ["doc_id", "h", "w", "n", "sketch"])
        release()

    return rows.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h binary, w array<long>, n int, sketch array<int>")


def word_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each word, of those in which bits i and j are both 1."""

    def run(batches):
        total, n = np.zeros((WORDS, BITS, BITS)), 0
        for b in batches:
            w = b.column(0).flatten().to_numpy().reshape(-1, WORDS)
            for j in range(WORDS if len(w) else 0):
                x = np.unpackbits(np.ascontiguousarray(w[:, j]).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                total[j] += x.T @ x
            n += len(w)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], ["n", "sums"])

    cells = prints.select("w").mapInArrow(run, "n long, sums array<double>").select("n", F.posexplode("sums").alias("cell", "s")).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    total = np.zeros(WORDS * BITS * BITS)
    total[cells["cell"].to_numpy()] = cells["s"].to_numpy()
    return (int(cells["n"][0].as_py()) if cells.num_rows else 0), total.reshape(WORDS, BITS, BITS)


#: word, bits, threshold
Part = tuple[int, list[int], int]


def allot(n: int, both: np.ndarray, parts: list[tuple[int, list[int]]], differ: float, recall: float, most: int = 3, steps: int = 300) -> tuple[float, list[int]]:
    """Thresholds with the least estimated cost at which a pair whose bits differ with chance `differ` is found with chance
    `recall`, by dynamic programming: what a part finds counts as -log of its chance to miss, rounded down to steps."""
    need = -log(1 - recall)
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * steps
    for word, bits in parts:
        p = np.diag(both[word]) / max(n, 1)
        chance = np.zeros(len(bits) + 1)
        chance[0] = 1
        for d in (2 * p * (1 - p))[bits]:
            chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
            chance[0] *= 1 - d
        options, balls, hit = [(0, 0.0)], 0, 0.0
        for t in range(most + 1):
            balls += comb(len(bits), t)
            hit += comb(len(bits), t) * differ**t * (1 - differ) ** (len(bits) - t)
            options.append((int(-log(max(1 - hit, 1e-12)) / need * steps), n * PROBE * balls + n * n * CANDIDATE * float(chance[: t + 1].sum())))
        after = [(float("inf"), [])] * (steps + 1)
        for have, (cost, chosen) in enumerate(best):
            if cost < float("inf"):
                for t, (gain, more) in enumerate(options):
                    to = min(steps, have + gain)
                    if cost + more < after[to][0]:
                        after[to] = (cost + more, [*chosen, t - 1])
        best = after
    return best[steps]


def plan(n: int, both: np.ndarray, differ: float, recall: float) -> list[Part]:
    """The probed parts, for the cheapest number of parts a word."""
    n, both = max(n, LEAST_PLANNED), both * (max(n, LEAST_PLANNED) / max(n, 1))
    options = []
    for m in (2, 3, 4, 5):
        parts = [(word, bits) for word in range(WORDS) for bits in group_bits(n, both[word], m)]
        cost, thresholds = allot(n, both, parts, differ, recall)
        if cost < float("inf"):
            options.append((cost, m, [(*part, t) for part, t in zip(parts, thresholds) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


def limit_of(bits: int, differ: float) -> int:
    """Bits that a pair may differ in: the mean and DEVIATIONS standard deviations."""
    return round(bits * differ + DEVIATIONS * (bits * differ * (1 - differ)) ** 0.5)


CHECKS = [f"c{i}" for i in range(CHECKED)]


def _rows(texts: DataFrame, parts: Sequence[Part], probe: bool) -> DataFrame:
    """part, key, id, the checked words and label: each text under its value of every part, or under all values within the
    part's threshold."""
    keys = []
    for i, (word, bits, t) in enumerate(parts):
        own = F.get("w", F.lit(word)).bitwiseAND(as_long(mask(bits)))
        near = F.array(own) if not t or not probe else F.transform(F.array(*[as_long(f) for f in flips(bits, t)]), lambda f: own.bitwiseXOR(f))
        keys.append(F.transform(near, lambda v: F.struct(F.lit(i).alias("part"), F.xxhash64(F.lit(i), v).alias("key"))))
    rows = texts.select(F.explode(F.flatten(F.array(*keys))).alias("k"), "id", *[F.get("w", F.lit(i)).alias(c) for i, c in enumerate(CHECKS)])
    return rows.select("k.part", "k.key", "id", *CHECKS, F.col("id").alias("label"))


def _divided(rows: DataFrame, level: int) -> DataFrame:
    """Rows that carry whole fingerprints, under runs of eight bits of words that this level alone uses."""
    runs = [(2 * level + r // 8, mask(list(range(r % 8 * 8, r % 8 * 8 + 8)))) for r in range(RUNS)]
    keys = [F.xxhash64(F.col("key"), F.lit(i), F.get("w", F.lit(word)).bitwiseAND(as_long(m))) for i, (word, m) in enumerate(runs)]
    return rows.select(F.explode(F.array(*keys)).alias("key"), *[c for c in rows.columns if c != "key"])


def _paired(probes: DataFrame, stored: DataFrame, parts: Sequence[Part], differ: float, ordered: bool = True) -> DataFrame:
    """Candidates a, b of one key whose labels differ and whose fingerprints, as far as the rows carry them, agree well enough,
    from the first part in the carried words that finds them. ordered: a pair meets twice."""
    other = stored.select(*[F.col(c).alias(f"o_{c}") for c in stored.columns])
    if "w" in probes.columns:
        apart = [F.get("w", F.lit(i)).bitwiseXOR(F.get("o_w", F.lit(i))) for i in range(WORDS)]
    else:
        apart = [F.col(c).bitwiseXOR(F.col(f"o_{c}")) for c in CHECKS]
    far = sum((F.bit_count(d) for d in apart[1:]), F.bit_count(apart[0]))
    on = (F.col("key") == F.col("o_key")) & (F.col("id") < F.col("o_id") if ordered else F.col("id") != F.col("o_id")) & (F.col("label") != F.col("o_label")) & (far <= limit_of(len(apart) * BITS, differ))
    if ordered:
        for i, (word, bits, t) in enumerate(parts):
            if word < len(apart):
                on &= ~((F.col("part") > i) & (F.bit_count(apart[word].bitwiseAND(as_long(mask(bits)))) <= t))
    if "salt" in probes.columns:
        on &= F.col("salt") == F.col("o_salt")
    return probes.join(other, on).select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"))


def similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of `least` or more."""
    needed = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    sketches = cut(texts.select("id", "n", "sketch").join(needed, "id", "left_semi"), "sketches")
    both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("y")), "b")
    whole, union = (F.col("an") <= SKETCH) & (F.col("bn") <= SKETCH), F.array_union("x", "y")
    first = F.slice(F.array_sort(union), 1, SKETCH)
    exact = F.size(F.array_intersect("x", "y")) >= F.lit(least) * F.size(union)
    close = F.size(F.array_intersect(first, F.array_intersect("x", "y"))) >= F.lit(least - SLACK) * F.size(first)
    out = cut(both.filter(F.least("an", "bn") >= F.lit(least - SLACK) * F.greatest("an", "bn")).filter(F.when(whole, exact).otherwise(close)).select("a", "b"), "similar")
    drop(sketches)
    return out


def _keys(stored: DataFrame, more_than: int) -> DataFrame:
    """Keys with more rows than that, of more than one label."""
    return cut(stored.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter((F.col("n") > more_than) & (F.col("lo") < F.col("hi"))).select("key"), "keys")


def _whole(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows with the whole fingerprint instead of the checked words."""
    return rows if "w" in rows.columns else rows.drop(*CHECKS).join(texts.select("id", "w"), "id")


def similar_groups(texts: DataFrame, least: float = 0.8, recall: float = 0.95, hot_bucket: int = HOT_BUCKET, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """id, root (the smallest id of its group) of the texts that are similar to another one, directly or over others.
    texts: id, w, n, sketch of distinct texts, a written table."""
    n, both = word_statistics(texts)
    differ = differing(least)
    parts = plan(n, both, differ, recall)
    hot_bucket = max(hot_bucket, HOT_FACTOR * n >> min(len(bits) for _, bits, _ in parts))
    stored, probes = _rows(texts, parts, False), _rows(texts, parts, True)
    edges, made = [], []

    def add(*pairs: DataFrame) -> None:
        all_ = pairs[0]
        for p in pairs[1:]:
            all_ = all_.unionByName(p)
        found = cut(all_.distinct(), "pairs")
        edges.append(similar(found, texts, least))
        drop(found)

    for level in range(LEVELS + 1):
        hot = _keys(stored, hot_bucket)
        made.append(hot)
        if not hot.take(1):
            add(_paired(probes, stored, parts, differ))
            break
        members, asking = (cut(_whole(x.join(hot, "key", "left_semi"), texts), "hot-rows") for x in (stored, probes))
        pivots = members.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("r") <= PIVOTS).drop("r")
        add(_paired(probes, stored.join(hot, "key", "left_anti"), parts, differ), _paired(asking, pivots, parts, differ, ordered=False))
        labels = cut(_groups(edges).withColumnRenamed("root", "label"), "labels")
        named = [cut(x.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled") for x in (members, asking)]
        several, large = _keys(named[0], 1), _keys(named[0], large_bucket)
        made += [members, asking, labels, *named, several, large]
        members, asking = (x.join(several, "key", "left_semi") for x in named)
        if not large.take(1):
            add(_paired(asking, members, parts, differ))
            break
        add(_paired(asking.join(large, "key", "left_anti"), members, parts, differ))
        members, asking = members.join(large, "key", "left_semi"), asking.join(large, "key", "left_semi")
        if level < LEVELS:
            stored, probes = (cut(_divided(x, level), "divided") for x in (members, asking))
            made += [stored, probes]
        else:
            salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
            add(_paired(asking.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), salted, parts, differ))
    out = cut(_groups(edges), "similar-groups")
    for t in [*made, *edges]:
        drop(t)
    return out


def _groups(edges: list[DataFrame]) -> DataFrame:
    all_ = edges[0]
    for e in edges[1:]:
        all_ = all_.unionByName(e)
    out = connected_components(all_.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return out.select(F.col("node").alias("id"), "root")


def _hash(text: Column) -> Column:
    """Of the whole text; all texts without words have the empty one's."""
    return F.unhex(F.md5(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit(""))))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, recall: float = 0.95, hot_bucket: int = HOT_BUCKET, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """docs with one row, that of the smallest doc_id, of each group of near copies; all columns kept.

    Two texts are linked if their sets of `shingle`-word shingles (A-Z lower-cased; shorter texts are one shingle) have a
    Jaccard similarity of `least` or more; groups are what links reach. Pairs just at `least` are found with a chance of
    `recall`, more similar ones with a higher one. Rows of equal text are one text, rows of equal doc_id and text one row;
    a null doc_id comes after all others. The columns __d and __h must be free."""
    if {"__d", "__h"} & set(docs.columns):
        raise ValueError("columns __d and __h are taken")
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__h": _hash(text)})
    own = cut(wide_prints(marked.select(F.col("__d").alias("doc_id"), F.col("__h").alias("h"), text.alias("text")), shingle), "prints")
    texts = cut(own.select("h", "w", "n", "sketch").dropDuplicates(["h"]).withColumn("id", F.monotonically_increasing_id()), "texts")
    groups = similar_groups(texts, least, recall, hot_bucket, large_bucket)
    roots = texts.select("h", "id").join(groups, "id", "left").select("h", F.coalesce("root", "id").alias("root"))
    rooted = cut(own.select("doc_id", "h").join(roots, "h"), "rooted")
    first = cut(rooted.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("first.doc_id", "first.h"), "first")
    later = rooted.select("doc_id", "h").distinct().join(first, ["doc_id", "h"], "left_anti").withColumnsRenamed({"doc_id": "__d", "h": "__h"})
    for t in (own, texts, groups):
        drop(t)
    return marked.join(later, ["__d", "__h"], "left_anti").dropDuplicates(["__d", "__h"]).select(*docs.columns)
