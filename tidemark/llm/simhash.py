"""Operator 8: SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit for each of 64 hash bits: 1 if over half of its word shingles' XXH64 values have it. Two
fingerprints link if at most `radius` bits differ. Equal fingerprints are one class, so only distinct ones are compared.

The 64 bits are grouped into parts, correlated bits together. If thresholds t_i of the parts add up to radius - parts + 1,
two linked fingerprints differ in at most t_i bits in some part i. A dynamic program allots the thresholds, unequally, such
that the estimated number of probes and candidates is least; the estimate comes from all fingerprints' bit statistics.
Each fingerprint is stored under its own value of every part and probes all values within t_i bits; candidates are
verified over all 64 bits. A stored value that many distinct fingerprints share is divided further: the bits are cut into
radius + 1 runs, one of which must agree in full, so that such a bucket is probed by these runs; this repeats while buckets
stay large. Buckets link through a pivot first, and what a pivot has joined isn't paired again; no component is lost.

Nulls count as empty texts; texts without words have fingerprint zero, which links like any other. Repeated rows get equal
results. A null doc_id belongs to the component of its fingerprint, whose name is the smallest doc_id that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, raw_texts, release, ship, table
from tidemark.llm.components import connected_components

BITS = 64
#: Relative costs of making one probe and of checking one candidate.
PROBE, CANDIDATE = 1.0, 0.5
#: A stored value of a part with more distinct fingerprints than this is divided further.
HOT_BUCKET = 256
#: Members of a bucket that all probes are compared with at once; larger buckets take further steps.
SMALL_BUCKET = 8
#: Parts are planned for this many fingerprints at least: below it any plan is cheap.
LEAST_PLANNED = 1 << 18
#: Copies into which a hot bucket that is left after all divisions is dealt.
SALTS = 16
#: One byte's bits as the bytes of a word, the highest bit first.
_LANES = np.array([sum((b >> (7 - k) & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of a text's word shingles, repeats included, in arrays of bounded length."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        yield np.array([digest(joined, 42)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, b = starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, len(a), 65536):
        yield np.array([digest(joined[i:j], 42) for i, j in zip(a[at : at + 65536], b[at : at + 65536])], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the rows of h (rows by words, uint64) have each bit; a word's highest bit comes first."""
    total = np.zeros(h.shape[1] * BITS, np.int64)
    for at in range(0, len(h), 255):  # so that a byte holds each count
        total += _LANES[h[at : at + 255].astype(">u8").view(np.uint8)].sum(axis=0).view(np.uint8)
    return total


def fingerprint(text: bytes, shingle: int) -> int:
    """The text's fingerprint; its first word's highest bit is the highest one."""
    counts, m = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, shingle):
        m += len(h)
        counts += bit_counts(h[:, None])
    return int.from_bytes(np.packbits(counts * 2 > m).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([fingerprint(t, shingle) for t in raw_texts(b)], dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and of those in which bits i and j are both 1: 64 x 64 sums over all of them."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            col = b.column(b.schema.get_field_index("fp")).to_numpy().view(np.uint64)
            for at in range(0, len(col), 50_000):
                x = np.unpackbits(col[at : at + 50_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                total += x.T @ x
            n += len(col)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], ["n", "sums"])

    parts = fps.select("fp").mapInArrow(run, "n long, sums array<double>")
    n, total = 0, np.zeros(BITS * BITS)
    cells = parts.select("n", F.posexplode("sums").alias("cell", "s")).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    if cells.num_rows:
        n = int(cells["n"][0].as_py())
        total[cells["cell"].to_numpy()] = cells["s"].to_numpy()
    return n, total.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each grows greedily by the bit most correlated with those it has. Bit 0 is the highest."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = list(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        mine = [free.pop(0)]
        while len(mine) < width:
            best = max(free, key=lambda b: (corr[b, mine].sum(), -b))
            free.remove(best)
            mine.append(best)
        out.append(sorted(mine))
    return out


def allocate(n: int, both: np.ndarray, parts: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """Thresholds with the least estimated cost, by dynamic programming over the parts. -1: the part isn't probed."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    costs = []
    for bits in parts:
        chance = np.zeros(len(bits) + 1)
        chance[0] = 1
        for b in bits:
            chance[1:] = chance[1:] * (1 - differ[b]) + chance[:-1] * differ[b]
            chance[0] *= 1 - differ[b]
        row, balls, comb = [0.0], 0, 1
        for t in range(min(radius, len(bits)) + 1):
            balls += comb
            comb = comb * (len(bits) - t) // (t + 1)
            row.append(n * PROBE * balls + n * n * CANDIDATE * chance[: t + 1].sum())
        costs.append(row)
    need = radius + 1  # of the sum of t_i + 1
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * need
    for row in costs:
        best = [min(((best[s - k][0] + row[k], [*best[s - k][1], k - 1]) for k in range(min(s, len(row) - 1) + 1) if best[s - k][0] < float("inf")), default=(float("inf"), [])) for s in range(need + 1)]
    return best[need]


def plan_parts(n: int, both: np.ndarray, radius: int, most: int = 5) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed, for the cheapest number of parts."""
    options = []
    for m in range(2, min(most, radius + 1) + 1):
        parts = group_bits(n, both, m)
        cost, thresholds = allocate(n, both, parts, radius)
        if cost < float("inf"):
            options.append((cost, m, [(b, t) for b, t in zip(parts, thresholds) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


def mask(bits: list[int]) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def flips(bits: list[int], most: int) -> list[int]:
    from itertools import combinations

    return [mask(list(c)) for k in range(most + 1) for c in combinations(bits, k)]


def as_long(x: int) -> Column:
    return F.lit(_signed(x)).cast("long")


def _near(radius: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius


def _apart(rows: DataFrame) -> DataFrame:
    """A join's exploded side: Spark takes it to be as small as what it was exploded from, and would broadcast all its rows."""
    return rows.hint("merge")


def _stored(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Each fingerprint under its own value of each part; other columns stay."""
    places = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(as_long(mask(bits)))) for i, (bits, _) in enumerate(parts)]
    return fps.select(F.explode(F.array(*places)).alias("key"), F.col("fp").alias("other"), *[F.col(c).alias(f"other_{c}") for c in fps.columns if c != "fp"])


def _probes(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """key, fp and any label: each fingerprint under all values of each part within its threshold."""
    out, more = None, [c for c in ("label",) if c in fps.columns]
    for i, (bits, t) in enumerate(parts):
        own = F.col("fp").bitwiseAND(as_long(mask(bits)))
        near = F.array(*[as_long(f) for f in flips(bits, t)])
        rows = fps.select(F.explode(F.transform(near, lambda f: F.xxhash64(F.lit(i), own.bitwiseXOR(f)))).alias("key"), "fp", *more)
        out = rows if out is None else out.unionByName(rows)
    return out


def _buckets(stored: DataFrame) -> DataFrame:
    """key, n, members: up to SMALL_BUCKET of a bucket's fingerprints, the smallest ones."""
    first = stored.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("other"))).filter(F.col("r") <= SMALL_BUCKET)
    counts = cut(stored.groupBy("key").agg(F.count("*").alias("n")), "counts")
    out = cut(counts.join(_apart(first.groupBy("key").agg(F.collect_list("other").alias("members"))), "key"), "buckets")
    drop(counts)
    return out


def _runs(level: int, radius: int) -> list[int]:
    """The 64 bits cut into radius + 1 runs, another way at each level: two linked fingerprints agree in one at least."""
    order = sorted(range(BITS), key=lambda b: (b * (1, 5, 11, 19)[level % 4] + level) % BITS)
    return [mask(list(r)) for r in np.array_split(order, radius + 1)]


def _divide(rows: DataFrame, column: str, level: int, radius: int) -> DataFrame:
    keys = [F.xxhash64(F.col("key"), F.lit(i), F.col(column).bitwiseAND(as_long(m))) for i, m in enumerate(_runs(level, radius))]
    return rows.select(F.explode(F.array(*keys)).alias("key"), *[c for c in rows.columns if c != "key"])


def _centers(stored: DataFrame, hot: DataFrame) -> DataFrame:
    """key, center of the hot buckets: the member nearest to the bucket's majority of bits."""
    rows = stored.join(hot, "key", "left_semi")
    ones = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(F.getbit("other", F.lit(b))).alias(f"b{b}") for b in range(BITS)])
    middle = None
    for b in range(BITS):
        bit = F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(_signed(1 << b)).cast("long")).otherwise(F.lit(0).cast("long"))
        middle = bit if middle is None else middle.bitwiseOR(bit)
    ones = cut(ones.select("key", middle.alias("middle")), "middles")
    far = F.bit_count(F.col("other").bitwiseXOR(F.col("middle")))
    # by parts of a bucket first, so that the join before it can be split
    nearest = rows.join(ones, "key").groupBy("key", F.pmod(F.xxhash64("other"), F.lit(32)).alias("part")).agg(F.min(F.struct(far.alias("far"), F.col("other").alias("center"))).alias("m"))
    return nearest.groupBy("key").agg(F.min("m").alias("m")).select("key", "m.center")


def _links_between(stored: DataFrame, probes: DataFrame, radius: int, levels: int = 3, hot_bucket: int = HOT_BUCKET) -> list[DataFrame]:
    """Links of fingerprints whose labels differ, as written tables. stored: key, other, other_label; probes: key, fp, label.
    What is still hot after the last division is dealt out by salt and compared in full."""
    found, made = [], []
    for level in range(levels + 1):
        spread = cut(stored.groupBy("key").agg(F.min("other_label").alias("lo"), F.max("other_label").alias("hi"), F.count("*").alias("n")), "spread")
        made.append(spread)
        # a bucket of one label has nothing for a probe of the same label
        probes = probes.join(spread.select("key", "lo", "hi"), "key").filter((F.col("lo") < F.col("hi")) | (F.col("lo") != F.col("label"))).drop("lo", "hi")
        hot = spread.filter(F.col("n") > hot_bucket).select("key")
        is_hot = bool(hot.take(1))
        cool = stored.join(hot, "key", "left_anti") if is_hot else stored
        linked = (probes["key"] == cool["key"]) & (F.col("label") != F.col("other_label")) & _near(radius)
        found.append(cut(probes.join(_apart(cool), linked).select("fp", "other").distinct(), "links"))
        if not is_hot:
            break
        stored, probes = stored.join(hot, "key", "left_semi"), probes.join(hot, "key", "left_semi")
        if level < levels:
            stored, probes = cut(_divide(stored, "other", level, radius), "divided"), cut(_divide(probes, "fp", level, radius), "divided")
            made += [stored, probes]
        else:
            stored = stored.withColumn("other_salt", F.pmod(F.xxhash64("other"), F.lit(SALTS)).cast("int"))
            probes = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            linked = (probes["key"] == stored["key"]) & (F.col("salt") == F.col("other_salt")) & (F.col("label") != F.col("other_label")) & _near(radius)
            found.append(cut(_apart(probes).join(stored, linked).select("fp", "other").distinct(), "links"))
    for t in made:
        drop(t)
    return found


def link_components(fps: DataFrame, radius: int, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """node, root of the graph of distinct fingerprints `fp` linked at `radius` or fewer bits; lone ones aren't listed.

    Probes are compared with up to SMALL_BUCKET members of their bucket, its pivots; that is all there is to most buckets. A
    large bucket's member nearest to its middle is a pivot too. Links to pivots come first, and with them most components;
    then, in buckets with more members, only pairs of different components are looked for, so that a bucket of thousands
    of near copies isn't paired with itself."""
    n, both = bit_statistics(fps)
    planned = max(n, LEAST_PLANNED)
    parts = plan_parts(planned, both * (planned / max(n, 1)), radius)
    stored = _stored(fps, parts)
    buckets = _buckets(stored)
    probes = _probes(fps, parts)
    close = lambda m: (m != F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(m)) <= radius)
    hits = cut(_apart(probes).join(buckets, (probes["key"] == buckets["key"]) & ((F.col("n") > SMALL_BUCKET) | F.exists("members", close))).select(probes["key"], "fp", F.filter("members", close).alias("members"), "n"), "hits")
    hot = buckets.filter(F.col("n") > hot_bucket).select("key")
    pivots = hits.select("fp", F.explode("members").alias("other"))
    if hot.take(1):
        pivots = pivots.unionByName(hits.join(_centers(stored, hot), "key").select("fp", F.col("center").alias("other")).filter((F.col("fp") != F.col("other")) & _near(radius)))
    edges = cut(pivots.distinct(), "links")
    made = [hits, buckets, edges]
    if hits.filter(F.col("n") > SMALL_BUCKET).take(1):
        first = connected_components(edges.select(F.col("fp").alias("u"), F.col("other").alias("v")))
        labelled = cut(fps.join(first, fps["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("label")), "labels")
        left = hits.filter(F.col("n") > SMALL_BUCKET).select("key", "fp")
        more = _links_between(_stored(labelled, parts), left.join(labelled, "fp"), radius, hot_bucket=hot_bucket)
        made += [labelled, *more]
        for found in more:
            edges = edges.unionByName(found)
    out = cut(connected_components(edges.select(F.col("fp").alias("u"), F.col("other").alias("v"))), "components")
    for t in made:
        drop(t)
    return out


def near_duplicate_components(docs: DataFrame, shingle: int = 4, radius: int = 4, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included) of each row; other columns are ignored."""
    ship(docs.sparkSession)
    own = cut(fingerprints(docs, shingle), "fingerprints")
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = link_components(classes.select("fp"), radius, hot_bucket)
    named = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    names = cut(named.groupBy("root").agg(F.min("first").alias("component_id")).join(named.select("fp", "root"), "root").select("fp", "component_id"), "names")
    for t in (classes, roots, named):
        drop(t)
    return own.join(names, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
