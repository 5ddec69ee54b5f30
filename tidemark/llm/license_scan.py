"""Operator 2 [native]: licence scans by a positional index of rare licence words. DataFrame functions only.

Each template is a licence's notice or grant with a mandatory key phrase. A first pass counts in how many texts each word of
the templates occurs. The index holds every word of every template with its place there. A second pass looks up each file's
own rarest licence words: from the highest inverse document frequency down, as many as it takes until every template whose
key phrase's words the file has is met by one of them. Each of their places in the file gives, by each posting, the place
where a template would begin. There the template is intersected with the file's words by relative position; a place's score
is the share of the template's inverse document frequency that agrees, and from `MIN_SCORE` on it counts if the whole key
phrase stands there. Base phrases are templates that are all key phrase.

A key phrase that stands in a file has its rarest word among those looked up, so no place is missed; a place that several
words lead to counts once. Nulls count as empty texts;
repeated rows get equal results; extra columns are ignored; without rows there are none.
"""

from __future__ import annotations

from collections.abc import Sequence

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lowered, table

#: What separates words, in lower-cased text, and words in a text that isn't.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases and labels: fixed values of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (template, key phrase, label).
TEMPLATES = (
    ("licensed under cc by nc", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc by sa", "cc-by-sa"),
    ("licensed under cc by nd", "cc by nd", "cc-by-nd"),
    ("licensed under a creative commons attribution license", "creative commons attribution", "cc-by"),
    ("licensed under the apache license version", "apache license", "apache"),
    ("released under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge", "mit"),
    ("this work is licensed under the gnu general public license version", "gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", "bsd"),
    ("subject to the terms of the mozilla public license", "mozilla public license", "mpl"),
    ("released under the bsd license", "bsd license", "bsd"),
    ("this is free and unencumbered software released into the public domain", "released into the public domain", "unlicense"),
)
MIN_SCORE = 0.5


def document_frequencies(docs: DataFrame, words: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those with each of the given words."""
    found = F.array_intersect(F.split(F.lower("text"), SEPARATORS), F.array(*[F.lit(w) for w in words]))
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.explode(F.concat(found, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    n = {r["word"]: r["count"] for r in rows}
    return n.get("", 0), n


def _possible(present: Column, templates: list[dict]) -> Column:
    """The templates all of whose key phrase's words are present."""
    return F.filter(F.array(*[F.when(F.size(F.array_except(F.array(*map(F.lit, t["key"])), present)) == 0, F.lit(i)) for i, t in enumerate(templates)]), lambda t: t.isNotNull())


def _rarest(present: Column, possible: Column, templates: list[dict], idf: dict[str, float]) -> Column:
    """The file's licence words from the highest inverse document frequency down, until each possible template's key phrase has one."""
    tops = F.array(*[F.lit(max(idf[w] for w in t["key"])) for t in templates])
    least = F.array_min(F.transform(possible, lambda t: F.element_at(tops, t + 1)))
    return F.transform(F.filter(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(x).alias("idf")) for w, x in sorted(idf.items())]), lambda x: (x["idf"] >= least) & F.array_contains(present, x["word"])), lambda x: x["word"])


def _places(words: str, possible: str, rare: str, templates: list[dict]) -> Column:
    """Verified places: struct(template, start of the key phrase, score)."""
    n, longest = len(templates), max(len(t["words"]) for t in templates)
    index: dict[str, list[tuple[int, int]]] = {}
    for i, t in enumerate(templates):
        for at_, w in enumerate(t["words"]):
            index.setdefault(w, []).append((i, at_))
    postings = F.create_map(*[x for w, found in sorted(index.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(i).alias("t"), F.lit(at_).alias("at")) for i, at_ in found]))])
    texts = F.array(*[F.array(*[F.lit(w) for w in t["words"]]) for t in templates])
    weights = F.array(*[F.array(*[F.lit(float(w)) for w in t["weights"]]) for t in templates])
    keys = F.array(*[F.array(*[F.lit(w) for w in t["key"]]) for t in templates])
    key_at = F.array(*[F.lit(t["key_at"]) for t in templates])
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: F.array_contains(rare, h["word"]))
    # a start and its template as one number, since equal numbers are found by hash
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.filter(F.element_at(postings, h["word"]), lambda p: F.array_contains(possible, p["t"])), lambda p: (h["at"] - p["at"] + longest).cast("long") * n + p["t"]))))
    starts = F.transform(starts, lambda x: F.struct((x % n).cast("int").alias("t"), (F.floor(x / n) - longest).cast("int").alias("start")))

    def at(array: Column, t: Column) -> Column:
        return F.element_at(array, t + 1)

    def stands(s: Column) -> Column:
        return (s["key_start"] >= 0) & (F.slice(words, F.greatest(s["key_start"], F.lit(0)) + 1, F.size(at(keys, s["t"]))) == at(keys, s["t"]))

    def score(s: Column) -> Column:
        # words before the file's beginning or after its end agree with nothing
        part = F.transform(at(texts, s["t"]), lambda w, i: F.when((s["start"] + i >= 0) & (s["start"] + i < F.size(words)), F.when(F.get(words, s["start"] + i) == w, F.element_at(at(weights, s["t"]), i + 1))))
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    scored = F.transform(starts, lambda s: F.struct(s["t"].alias("t"), (s["start"] + at(key_at, s["t"])).alias("key_start"), F.least(F.lit(1.0), score(s)).alias("score")))
    return F.filter(F.filter(scored, lambda s: s["score"] >= MIN_SCORE), stands)


def prepare(n: int, df: dict[str, int], base: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str, str]]) -> tuple[list[dict], dict[str, float]]:
    """Templates with their weights, base phrases first, and the inverse document frequency of their words."""
    ready = [(p.split(), p.split(), label) for p, label in base] + [(text.split(), key.split(), label) for text, key, label in templates]
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 0.01 for words, *_ in ready for w in words}
    out = []
    for words, key, label in ready:
        total = sum(idf[w] for w in words)
        key_at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out.append({"words": words, "key": key, "key_at": key_at, "weights": [idf[w] / total for w in words], "label": label})
    return out, idf


def scan_licenses(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    vocabulary = sorted({w for text, *_ in [*base, *templates] for w in text.split()})
    ready, idf = prepare(*document_frequencies(docs, vocabulary), base, templates)
    tops = sorted({max(t["key"], key=idf.get) for t in ready})
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    maybe = F.col("text").rlike("(?i)" + "|".join(map(re.escape, tops)))
    d = d.select("doc_id", F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"), F.when(maybe, F.filter(F.split(lowered("text"), SEPARATORS), lambda w: w != "")).alias("words"))
    d = d.withColumn("present", F.array_intersect("words", F.array(*map(F.lit, vocabulary))))
    d = d.withColumn("possible", _possible(F.col("present"), ready))
    d = d.withColumn("rare", F.when(F.size("possible") > 0, _rarest(F.col("present"), F.col("possible"), ready, idf)))
    d = d.select("doc_id", "n_words", F.when(F.col("rare").isNotNull(), _places("words", "possible", "rare", ready)).alias("places"))
    n_base = len(base)
    own = F.filter("places", lambda p: p["t"] < n_base)
    labels = F.array(*[F.lit(t["label"]) for t in ready])

    def joined(places: Column) -> Column:
        return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.element_at(labels, p["t"] + 1)))), ","), F.lit(""))

    starts = F.transform(own, lambda p: p["key_start"].cast("long"))
    return d.select(
        "doc_id", "n_words", F.coalesce(F.size(own), F.lit(0)).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"), joined(F.col("places")).alias("labels"), F.round(F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)), 6).alias("score"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
