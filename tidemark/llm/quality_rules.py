"""Operator 10 [native]: quality rules by divergence from language references. DataFrame functions only.

Each text gives two histograms: its characters by class (lower case and other, upper case, digits, punctuation, symbols,
white space, bytes beyond ASCII) and its words over a list of common words plus all others. The reference of a language is
the sum of its texts' histograms, first of all rows, then of those whose characters are no farther from the first reference
than the mean, so that junk has no part in it; languages with fewer than `MIN_DOCS` such rows, and rows without a language,
take the sum over all languages. A text is dropped if either histogram's Jensen-Shannon distance (base 2, 0 to 1) from its reference
is over its limit; texts with fewer than `MIN_WORDS` words are too short to be compared and pass this rule.

Before that the base rules count, as the contract fixes them, words of runs of other than white space. A word repeats if it
lies in an 8-word window that occurs twice or more in its text: windows are compared by 64-bit hashes that are built by
doubling, and only texts with two equal hashes look further, by sorting the hashes with their places.

Nulls count as empty texts (no words, so the base rules fail); repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
#: Common words of four languages.
COMMON = ("the", "of", "and", "to", "in", "is", "that", "for", "der", "die", "und", "das", "den", "mit", "von", "ist", "le", "la", "de", "et", "les", "des", "que", "un", "el", "los", "y", "en", "por", "con", "se", "del")
WINDOW = 8
MIN_WORDS, MIN_DOCS = 50, 20
#: A distance's limit is the first figure plus the second divided by the number of words: short texts scatter more.
CHARS_LIMIT, WORDS_LIMIT = (0.165, 3.0), (0.32, 2.0)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _shift(a: str, by: int) -> Column:
    return F.slice(a, by + 1, F.size(a))


def _count(text: str, others: str) -> Column:
    """Characters of a text without those that the pattern matches."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and both histograms of each row, from one scan of the texts."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("words", _words(F.col("text")))
    d = d.withColumn("hash", F.transform("words", lambda w: F.xxhash64(w))).withColumn("common", F.filter("words", lambda w: w.isin(*COMMON)))
    d = d.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long")).withColumn("n_words", F.size("words").cast("long")).drop("words")
    for at in (1, 2, 4):
        d = d.withColumn("hash", F.zip_with("hash", _shift("hash", at), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("hash", F.when(F.col("n_words") >= WINDOW, F.slice("hash", 1, F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("again", F.size(F.array_distinct("hash")) < F.size("hash"))
    placed = F.array_sort(F.transform("hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("placed", F.when(F.col("again"), placed)).drop("hash")
    # a place repeats if its neighbour on either side, in the order of hashes, has the same hash
    after = F.zip_with("placed", _shift("placed", 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    d = d.withColumn("starts", F.when(F.col("again"), F.sort_array(F.array_distinct(F.flatten(F.filter(after, lambda x: x.isNotNull()))))))
    covered = F.aggregate(F.zip_with("starts", _shift("starts", 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x)
    d = d.withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(F.lit(0).cast("long"))).drop("placed", "starts", "again")
    d = d.withColumn("lines", F.when(F.instr("text", "\n") > 0, F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")))
    d = d.withColumn("n_dup_lines", F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long")).drop("lines")
    d = d.withColumn("n_chars_", F.length("text").cast("long")).withColumn("n_symbols", _count("text", r"[^#*$%&|<>]+")).withColumn("digits", _count("text", r"[^0-9]+"))
    d = d.withColumn("upper", _count("text", r"[^A-Z]+")).withColumn("points", _count("text", r"[^.,;:!?'\"()\-]+")).withColumn("beyond", (F.octet_length("text") - F.col("n_chars_")).cast("long"))
    spaces = F.col("n_chars_") - F.col("word_chars")
    rest = F.col("n_chars_") - spaces - F.col("n_symbols") - F.col("digits") - F.col("upper") - F.col("points")
    chars = F.array(rest, F.col("upper"), F.col("digits"), F.col("points"), F.col("n_symbols"), spaces, F.col("beyond"))
    counted = F.transform(F.array(*[F.lit(w) for w in COMMON]), lambda w: F.size(F.filter("common", lambda x: x == w)).cast("long"))
    words = F.concat(counted, F.array(F.col("n_words") - F.size("common")))
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("chars"), words.alias("common"))


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def jensen_shannon(p: str, q: str) -> Column:
    """Distance (the divergence's square root, base 2) of two columns of shares."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def _reference(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    n_chars, n_words = 7, len(COMMON) + 1
    sums = [F.sum(F.element_at("chars", i + 1)).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.element_at("common", i + 1)).alias(f"w{i}") for i in range(n_words)]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    return out.select(*keys, "n", _share(F.array(*[f"c{i}" for i in range(n_chars)])).alias(f"{prefix}_chars"), _share(F.array(*[f"w{i}" for i in range(n_words)])).alias(f"{prefix}_words"))


def _with_distances(f: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of features with both distances from their references, which the rows of `base` give."""
    own = _reference(base.filter("lang is not null"), ["lang"], "own").filter(F.col("n") >= MIN_DOCS).drop("n")
    all_ = _reference(base, [], "all").drop("n")
    d = f.join(own, "lang", "left").crossJoin(F.broadcast(all_))  # one row
    d = d.select(*f.columns, _share(F.col("chars")).alias("p"), _share(F.col("common")).alias("w"), F.coalesce("own_chars", "all_chars").alias("rp"), F.coalesce("own_words", "all_words").alias("rw"))
    return d.select(*f.columns, jensen_shannon("p", "rp").alias("chars_distance"), jensen_shannon("w", "rw").alias("words_distance"))


def judge_quality(docs: DataFrame, min_words: int = MIN_WORDS, chars_limit: tuple[float, float] = CHARS_LIMIT, words_limit: tuple[float, float] = WORDS_LIMIT) -> DataFrame:
    """The base counts, both distances (null where a text is too short) and the verdict of each row."""
    return _verdicts(cut(features(docs), "quality"), min_words, chars_limit, words_limit)


def _verdicts(f: DataFrame, min_words: int, chars_limit: tuple[float, float], words_limit: tuple[float, float]) -> DataFrame:
    first = _with_distances(f, f).filter(F.col("n_words") >= min_words)
    middle = first.groupBy(F.coalesce("lang", F.lit("")).alias("l")).agg(F.avg("chars_distance").alias("middle"))
    usual = first.join(middle, F.coalesce("lang", F.lit("")) == F.col("l")).filter(F.col("chars_distance") <= F.col("middle")).select(*f.columns)
    d = _with_distances(f, cut(usual, "usual"))
    long_enough = F.col("n_words") >= min_words
    d = d.withColumns({c: F.when(long_enough, F.col(c)) for c in ("chars_distance", "words_distance")})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = lambda c, limit: F.coalesce(F.col(c) <= limit[0] + F.try_divide(F.lit(limit[1]), F.col("n_words")), F.lit(True))
    near = within("chars_distance", chars_limit) & within("words_distance", words_limit)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), F.round("chars_distance", 6).alias("chars_distance"), F.round("words_distance", 6).alias("words_distance"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))
