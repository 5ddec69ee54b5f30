"""The pipeline's stages on a small corpus with planted cases, and their contract."""

import random

import corpus_pipeline
from tidemark.llm import toxicity


def words(r, n):
    return " ".join("".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(n))


def lines(r, n):
    return "\n".join(words(r, 12) for _ in range(n))


def build(spark, folder):
    r = random.Random(11)
    item = words(r, 30)
    docs = [(i, lines(r, 8), "en", "s", 0) for i in range(40)]
    passage = lines(r, 6)
    docs += [(100, docs[0][1] + "\n" + passage, "en", "s", 0), (101, lines(r, 3) + "\n" + passage + "\n" + lines(r, 2), "en", "s", 0)]
    docs += [(110, docs[5][1], "en", "s", 0)]  # a copy
    near = words(r, 300)
    docs += [(120, near, "en", "s", 0), (121, near.replace(near.split()[150], "changed", 1), "en", "s", 0)]
    docs += [(130, lines(r, 2) + "\n" + item + " " + words(r, 20), "en", "s", 0)]
    docs += [(140, "you idiot and you pathetic worthless moron. " + words(r, 60), "en", "s", 0), (150, None, None, None, None)]
    docs = [(a, t, b, c, len(t or "")) for a, t, b, c, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, words(r, 40))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {d[0] for d in docs}


def test_each_stage(spark, tmp_path):
    folder = str(tmp_path)
    everything = build(spark, folder)
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if i < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        ids[name] = {r.doc_id for r in docs.collect()}
        if name == "line_dedup":
            kept = {r.doc_id: r for r in docs.collect()}
            assert len(kept[100].text.split("\n")) == 6 and len(kept[101].text.split("\n")) == 5
            assert kept[101].n_chars == len(kept[101].text)
    assert everything - ids["toxicity"] == {140}
    assert ids["toxicity"] - ids["line_dedup"] == {110}
    assert ids["line_dedup"] - ids["simhash_near_dedup"] == {121}
    assert ids["simhash_near_dedup"] - ids["decontamination"] == {130}
    assert ids["decontamination"] == ids["sentencepiece"] == everything - {140, 110, 121, 130}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == ids["sentencepiece"]


def test_queries_are_registered():
    import __spark_entry__

    q = __spark_entry__.queries()
    assert "pipeline" in q and sum(n.startswith("op") for n in q) == 10
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert toxicity.grammar() is not None
