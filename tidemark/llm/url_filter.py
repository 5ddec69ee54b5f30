"""Operator 7: URL rules and a Bloom filter cascade over host names.

A url's host and path first meet a small table of rules; where none fits, a block list of host keys decides. The list is
held as a cascade: level 0 encodes the listed keys, level 1 those keys of the corpus's complete key universe that level 0
takes for listed though they aren't, level 2 the listed ones that level 1 takes for false positives, and so on until a
level has no false positives. Every key of the universe is then judged exactly, by probes alone and without a join.

A page's keys are its host and all parents of it. The keys are dealt by hash into shards of at most about `max_keys` listed
keys (10 bits each: 5 MB for 4 million), each with a cascade of its own; one shard at a time is sent to all executors, and
each further one costs a pass over the pages' hosts. Usual lists are one shard.

Null urls and urls without `://` have empty host and path, fit no rule and are allowed. Of rules that fit the longest wins, and
equally long ones can't fit both. Rows repeat as they come; other columns are ignored; null keys of the list are left out; an
empty table or an empty list gives an empty result or no block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, lowered, mix, ship, table

#: (host, path, verdict): fixed values of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words between dots or hyphens of a host that put it on the default list.
LISTED_WORDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "farm", "pills", "porn", "spam", "track", "viagra", "win", "xxx")
BITS_PER_KEY, PROBES, MOST_LEVELS = 10, 4, 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lowered(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_keys(host: Column) -> Column:
    """The host and all its parents."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def looks_listed(key: Column, words: Sequence[str] = LISTED_WORDS) -> Column:
    """Whether the key's first label has a listed word. Parents follow from their own first label."""
    return F.arrays_overlap(F.split(F.element_at(F.split(key, r"\."), 1), "-"), F.array(*[F.lit(w) for w in words]))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, probes: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a, b = mix(h1 ^ salt), mix(h2 + salt) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(probes)])


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).view(np.uint64)


class Cascade:
    """Alternating Bloom filters; member() is exact for all keys of the universe it was built over."""

    def __init__(self, bits_per_key: int = BITS_PER_KEY, probes: int = PROBES) -> None:
        self.bits_per_key, self.probes = bits_per_key, probes
        self.levels: list[tuple[int, np.ndarray]] = []  # bits, words

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, words = self.levels[level]
        at = _places(h1, h2, level, bits, self.probes)
        return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=0)

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        open_ = np.ones(len(h1), bool)
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        for i in range(len(self.levels)):
            miss = open_.copy()
            miss[open_] = ~self.passes(i, h1[open_], h2[open_])
            out[miss] = i % 2 == 1
            open_ &= ~miss
        return out

    def add(self, keys: DataFrame, n: int) -> None:
        """One level over n keys: each task sets its bits, equal words meet by OR."""
        probes, level, bits = self.probes, len(self.levels), max(64, n * self.bits_per_key)

        def run(batches):
            words = np.zeros((bits + 63) // 64, np.uint64)
            for b in batches:
                at = _places(_column(b, "h1"), _column(b, "h2"), level, bits, probes).ravel()
                np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
            used = np.flatnonzero(words)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(words[used].view(np.int64))], ["word", "bits"])

        words = np.zeros((bits + 63) // 64, np.uint64)
        for row in keys.select("h1", "h2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
            words[row.column(0).to_numpy()] = row.column(1).to_numpy().view(np.uint64)
        self.levels.append((bits, words))


def _hits(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(cascade.passes(level, _column(b, "h1"), _column(b, "h2"))))

    return keys.select("h1", "h2").mapInArrow(run, "h1 long, h2 long")


def build_cascade(keys: DataFrame, bits_per_key: int = BITS_PER_KEY, probes: int = PROBES) -> Cascade:
    """keys: one row for each key of the universe, with h1, h2 and `listed`, a written table."""
    cascade, made = Cascade(bits_per_key, probes), []
    inside, outside = keys.filter("listed"), keys.filter("not listed")
    n = inside.count()
    while n:
        if len(cascade.levels) == MOST_LEVELS:  # each level halves what is left at least; only equal hashes of two keys go on for ever
            raise RuntimeError("the cascade does not settle: two keys have equal hashes")
        cascade.add(inside, n)
        hit = cut(_hits(outside, cascade, len(cascade.levels) - 1), "url-level")
        made.append(hit)
        inside, outside = hit, inside
        n = inside.count()
    for t in made:
        drop(t)
    return cascade


def default_list(pages: DataFrame, words: Sequence[str] = LISTED_WORDS) -> DataFrame:
    """key: the hosts of the pages, and their parents, whose first label has a listed word."""
    hosts = pages.select(host_and_path(F.col("url"))[0].alias("host")).distinct()
    return hosts.select(F.explode(host_keys(F.col("host"))).alias("key")).distinct().filter(looks_listed(F.col("key"), words))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_keys: int = 4_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict, listed_host of each row. listed: a column `key` of host names, A-Z in any case."""
    spark = pages.sparkSession
    ship(spark)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    own = parsed.select("host").distinct().select(F.explode(host_keys(F.col("host"))).alias("key"), F.lit(False).alias("listed"))
    both = own.unionByName(listed.select(lowered("key").alias("key"), F.lit(True).alias("listed")).filter("key is not null"))
    keys = cut(both.groupBy("key").agg(F.max("listed").alias("listed")).select(*_hashes(F.col("key")), "listed"), "url-keys")
    n = {r.listed: r["count"] for r in keys.groupBy("listed").count().collect()}
    shards = max(1, -(-max(n.get(True, 0), n.get(False, 0) // 50) // max(1, max_keys)))
    schema = "page_id long, host string, path string, h1 array<long>, h2 array<long>, listed_host boolean"
    h = host_keys(F.col("host"))
    rows = parsed.select("page_id", "host", "path", F.transform(h, lambda k: F.xxhash64(k)).alias("h1"), F.transform(h, lambda k: F.xxhash64(F.lit("second"), k)).alias("h2"), F.lit(False).alias("listed_host"))
    for shard in range(shards):
        shared = spark.sparkContext.broadcast(build_cascade(keys.filter(F.pmod("h1", F.lit(shards)) == shard)))

        def run(batches, shared=shared, shard=shard):
            cascade = shared.value
            for b in batches:
                a, c = b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy()
                lengths = b.column(3).value_lengths().to_numpy()
                mine, found = a % shards == shard, np.zeros(len(a), np.int64)
                found[mine] = cascade.member(a[mine].view(np.uint64), c[mine].view(np.uint64))
                sums, ends = np.concatenate([[0], np.cumsum(found)]), np.cumsum(lengths)
                hit = (sums[ends] > sums[ends - lengths]) | b.column(5).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hit)], b.schema.names)

        before, rows = rows, rows.mapInArrow(run, schema)
        if shards > 1:  # so that the shard can go
            rows = cut(rows, "url-rows")
            shared.destroy()
            drop(before)
    drop(keys)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed_host"), "block").otherwise("allow")).alias("verdict"), "listed_host")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, default_list(pages))


_FIT = "CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 0 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 1 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 2 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 3 END"
ORACLE = f"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
fitted AS (
  SELECT *, {_FIT} AS fit,
         len(list_filter(string_split(host, '.'), lambda x: len(list_intersect(string_split(x, '-'), [{', '.join(f"'{w}'" for w in LISTED_WORDS)}])) > 0)) > 0 AS listed_host FROM parsed)
SELECT page_id, host, path, CASE fit WHEN 0 THEN 'example.net/en/' WHEN 1 THEN 'example.com/de/' WHEN 2 THEN 'org/fr/' WHEN 3 THEN 'net/' END AS rule,
       CASE WHEN fit IN (0, 2) THEN 'allow' WHEN fit IN (1, 3) THEN 'block' WHEN listed_host THEN 'block' ELSE 'allow' END AS verdict, listed_host
FROM fitted
"""
