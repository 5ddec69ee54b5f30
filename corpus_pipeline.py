"""Corpus preparation in five stages over `documents`. Each stage works on what its predecessor has kept: its result is
written as Parquet and read again. run() applies them all.

1. toxicity: documents that score 0.5 or more for toxicity go.
2. line dedup: later copies of repeated line runs of 50 words or more go; documents that lose all their lines go with them.
3. SimHash near-dedup: of each group of near copies (five-word shingles) the smallest doc_id stays.
4. benchmark decontamination: documents that hold a benchmark item, up to 5 % edits, go.
5. SentencePiece: ids and the text they decode to, as digests, of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.llm.decontamination import without_leaks
from tidemark.llm.line_dedup import delete_repeated_runs
from tidemark.llm.sentencepiece_codec import default_model_path, encode_digests
from tidemark.llm.near_copies import without_near_duplicates
from tidemark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = delete_repeated_runs(docs).filter(F.col("__removed") < F.col("__lines"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_digests(docs, default_model_path())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: Suffix classes, near-duplicate components, edit distances and BPE have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
