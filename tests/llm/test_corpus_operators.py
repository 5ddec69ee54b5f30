"""Operators that look at a whole corpus against plain versions: language model, toxicity, benchmark passages, line runs."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language_model, line_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# --- language model


def corpus(seed=0, n=120):
    r = random.Random(seed)
    words = ["the", "of", "and", "cat", "sat"] + ["w%d" % i for i in range(200)]
    out = [(i, " ".join(words[min(int(r.expovariate(0.05)), len(words) - 1)] for _ in range(r.choice([0, 1, 5, 80]))), "x") for i in range(n)]
    return [*out, (n, None, None), (n + 1, "É\x85é A a\tB", "x"), (n + 2, "y" * 3000, "x"), (5, out[5][1], "x"), (None, "the cat", "x")]


def in_training(key):
    return key is None or zlib.crc32(str(key).encode()) % 7 != 2


@pytest.mark.parametrize("head", [1 << 18, 20, 0])
def test_base_scores_match_brute_force(spark, head):
    rows = corpus()
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b" "]
    c = Counter(w for k, t, _ in rows if in_training(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string, token string"), head_size=head).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, t, _ in rows:
        r, w = by[k], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not in_training(k), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score <= 1e-9


def plain_scores(rows, d=0.5):
    """log10 probabilities by the formula, with exact dictionaries in place of the filters, and the vocabulary."""
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b" "]
    read = lambda c: 0.0 if not c else 1.0 if c == 1 else 1.5 * 2 ** (c.bit_length() - 1) - 0.5
    single, pairs = Counter(), Counter()
    for k, t, _ in rows:
        if in_training(k):
            w = tokens(t)
            single.update(w)
            pairs.update(zip([b" ", *w], w))
    weight, types = Counter(), Counter()
    for (v, _), c in pairs.items():
        weight[v] += read(c)
        types[v] += 1

    def p(v, w, head):
        size = lambda x: single[x] if x in head else read(single[x])
        p1 = (size(w) + 1) / (sum(map(size, single)) + len(single) + 1)
        return max(read(pairs[v, w]) - d, 0) / weight[v] + d * types[v] / weight[v] * p1 if weight[v] else p1

    return lambda t, head: sum(math.log10(p(v, w, head)) for v, w in zip([b" ", *tokens(t)], tokens(t))), p, single


@pytest.mark.parametrize("head, shard_tokens, chunk_tokens", [(1 << 18, 1 << 20, 1 << 18), (20, 300, 100), (0, 50, 1)])
def test_scores_match_brute_force_at_any_size_of_shards(spark, head, shard_tokens, chunk_tokens):
    rows = corpus(2)
    score, p, single = plain_scores(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    _, model, _, shards = language_model.train(docs.filter(~language_model.held_out("doc_id", 7, 2)), head, shard_tokens)
    assert (shards.count() > 5) == (shard_tokens < 1000)
    got = {r.doc_id: r.score for r in language_model.score_documents(docs, head_size=head, shard_tokens=shard_tokens, chunk_tokens=chunk_tokens).collect()}
    for k, t, _ in rows:
        assert got[k] == pytest.approx(score(t, model.head.ids), rel=1e-5, abs=1e-5), k
    for context in (b"the", b"cat", b" ", b"never seen"):
        unseen = 1 - sum(p(context, w, model.head.ids) for w in single)
        assert unseen == pytest.approx(p(context, b"not a token", model.head.ids), abs=1e-3)


def test_model_beats_the_base_on_held_out_text(spark, sf_dir):
    r = language_model.op5_language_model(spark, sf_dir).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_filter_reads_counts_back():
    import numpy as np

    n = 100_000
    keys, q = np.arange(n, dtype=np.uint32) * 7919, 1 + np.arange(n) % 5
    f = language_model.CountFilter.build(keys, q)
    got = f.quanta(keys)
    assert (got >= q).all() and (got == q).mean() > 0.999
    assert (f.quanta(np.arange(50_000, dtype=np.uint32) * 31 + 3_000_000_000) > 0).mean() < 0.001
    assert len(f.words) * 64 < 3.1 * n * language_model.BITS_PER_ENTRY
    assert language_model.quanta_of(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def test_filters_hash_a_key_once_a_level(monkeypatch):
    import numpy as np

    keys, q = np.arange(1000, dtype=np.uint32), np.full(1000, 3, np.uint8)
    whole, hashed, mix = language_model.CountFilter.build(keys, q), [], language_model.mix
    monkeypatch.setattr(language_model, "mix", lambda x: hashed.append(len(x)) or mix(x))
    monkeypatch.setattr(language_model, "BLOCK", 7)
    f = language_model.CountFilter.build(keys, q)
    assert sum(hashed) == 3000 and (f.words == whole.words).all()
    hashed.clear()
    assert (f.quanta(keys) >= 3).all() and sum(hashed) < 4100


def test_tokens_are_counted_as_they_are_split(spark):
    odd = ["".join(f"a{chr(i)}B" for i in range(128)), "É\u00a0é \u3000 x\x1cx\x85x", "", " ", None, "a a\ta", "\r\n\x0b\x0cz"] * 2
    docs, want = spark.createDataFrame([(t,) for t in odd], "text string"), Counter(w for t in odd for w in language_model.tokens((t or "").encode()))
    for most in (1, 20, 1 << 23):
        assert {r.token.encode(): r.c for r in language_model.count_tokens(docs, most).collect()} == want


@pytest.mark.parametrize("size", [1, 300, 1 << 20])
def test_packs_hold_every_row_once(spark, size):
    texts = ["", None, "a b", "é 日本 x", "w " * 5000, None, "a b", "", "z"]
    rows = [(None if i == 3 else i, i % 2 == 0, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").repartition(2)
    packs = language_model.pack(docs, 3, size).toArrow()
    assert set(packs["chunk"].to_pylist()) <= {0, 1, 2}
    numbers, ids, marks, words = language_model.unpack(packs)
    assert numbers == sorted(set(numbers))
    key = lambda x: (x[0] is None, x[0] or 0)
    got = sorted(zip(ids, marks, words), key=key)
    assert got == sorted(((d, m, language_model.tokens((t or "").encode())) for d, m, t in rows), key=key)
    assert language_model.pack(docs.limit(0), 3, size).count() == 0


def test_language_model_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score_documents(none).count() == 0
    only = spark.createDataFrame([(next(i for i in range(100) if not in_training(i)), "a b")], "doc_id long, text string")
    r = language_model.score_documents(only).first()
    assert (r.train_tokens, r.n_known, r.score, r.base_score) == (0, 0, 0.0, 0.0)


# --- toxicity


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot": 3.0, "blaf*": 4.0})
    plain, target, negated, said = (g.clause(t) for t in ("an idiot here", "you idiot", "not an idiot", "she said an idiot"))
    assert target > plain > said > negated > 0
    assert g.clause("i will kill you") > g.clause("i kill") > 0 and g.clause("a quiet day") == 0
    assert g.clause("not a man. idiot") > 0
    assert g.matches("x blaffen! idiot; all well.")[0] == pytest.approx(7.0) and g.matches("the skill of idiotic men")[0] == 0
    began = time.perf_counter()
    assert g.matches("you idiot. " * 500_000)[0] == pytest.approx(500_000 * g.clause("you idiot")) and time.perf_counter() - began < 30  # linear in the length
    assert g.matches("") == (0.0, 0.0) and g.matches("a " * 50_000 + "idiot")[1] == 3.0


def test_composition_multiplies_factors():
    m = toxicity.grammar()
    assert m.arcs[m.start, toxicity.INSULT][1] == 1.0
    s = m.arcs[m.start, toxicity.NEGATION][0]
    assert m.arcs[s, toxicity.INSULT][1] == pytest.approx(0.6)
    s = m.arcs[s, toxicity.REPORT][0]
    assert m.arcs[s, toxicity.INSULT][1] == pytest.approx(0.48)


def planted(n=900):
    r = random.Random(7)
    words = ["w%s" % chr(97 + i % 26) * (1 + i % 3) + chr(97 + i // 26) for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        text, toxic = [r.choice(words) for _ in range(r.choice([30, 200]))], int(i % 9 == 0)
        if toxic:
            for _ in range(4):
                text.insert(r.randrange(len(text)), "grumf" + r.choice(["en", "o", "ig", "xx", "y"]))
        docs.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = planted()
    extra = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "grumfo grumfen grumfy grumfo", "en", "s", 0), docs[0]]
    d = spark.createDataFrame([*docs, *extra], DOC).withColumn("score", F.lit(0.1))
    lab = spark.createDataFrame([*labels, (1, None, None), (0, 1, 0), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.judge_toxicity(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    by, truth = {r.doc_id: r for r in got}, {k: t for k, _, t in labels}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [k for k, r in by.items() if r.held_out and k in truth]
    assert sum(by[k].predicted == truth[k] for k in held) / len(held) > 0.97
    assert by[None].predicted == 1 and by[9000].score == by[9001].score < 0.5
    kept = toxicity.without_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(not r.predicted for r in got)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(1, "you idiot, you pathetic moron"), (2, "a fine day")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.judge_toxicity(d, none).collect()} == {1: 1, 2: 0}
    assert toxicity.judge_toxicity(d.limit(0), none).count() == 0


# --- benchmark passages


def distance(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1]))
        prev = cur
    return min(prev)


def test_bit_parallel_distance():
    r = random.Random(3)
    for _ in range(300):
        p, t = "".join(r.choice("ab c") for _ in range(r.randint(1, 90))), "".join(r.choice("ab c") for _ in range(r.randint(0, 120)))
        assert decontamination.Pattern(p).best(t, -1)[0] == distance(p, t)


def test_leaks_match_brute_force(spark):
    r = random.Random(4)
    items = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randint(41, 90))).strip().replace("  ", " b")) for i in range(6)]
    items += [(6, items[0][1]), (7, None), (8, "short"), (None, items[1][1]), (9, "What is it? A cat."), (10, " ")]
    docs = []
    for k in range(60):
        t = list(r.choice(items[:6])[1])
        for _ in range(r.randint(0, 7)):
            at = r.randrange(len(t))
            t[at : at + r.randint(0, 1)] = r.choice("abcd")
        docs.append((k, "".join(r.choice("abcd ") for _ in range(40)) + "".join(t).upper().replace(" ", " \n", 1) + "".join(r.choice("abcd ") for _ in range(40)), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (0, docs[0][1], "x"), (None, docs[1][1], "x"), (102, "abc " * 20_000, "x"), (103, "so what  is it? A CAT. yes", "x"), (104, "shortly, aShort", "x"), (105, "(Short)", "x")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    norm = decontamination.normalize
    want = [(k, i, n) for k, t, _ in docs for i, p in items if p and len(norm(p)) >= 40 and k != 102 and (n := distance(norm(p), norm(t or ""))) <= int(len(norm(p)) * 0.05)]
    want += [(k, i, 0) for k, t, _ in docs for i, p in items if p and 0 < len(norm(p)) < 40 and re.search(r"(?<![^\W_])" + re.escape(norm(p)) + r"(?![^\W_])", norm(t or ""))]
    assert {(103, 9, 0), (105, 8, 0)} <= set(want) and not any(k == 104 for k, *_ in want) and any(i is None for _, i, _ in want)
    order = lambda rows: sorted(rows, key=str)
    for block in (4_000_000, 150):
        got = decontamination.find_leaks(d, b, block_chars=block).collect()
        assert order((x.doc_id, x.item_id, x.distance) for x in got) == order(want)
        bad = {k for k, _, _ in want}
        kept = decontamination.without_leaks(d, b, block_chars=block)
        assert kept.columns == d.columns and order(x.doc_id for x in kept.collect()) == order(k for k, _, _ in docs if k not in bad)
    assert decontamination.find_leaks(d, b.limit(0)).count() == 0 and decontamination.find_leaks(d.limit(0), b).count() == 0


# --- line runs


def plain_runs(docs, least):
    order = sorted(docs, key=lambda x: (x[0] is None, x[0] or 0))
    lines = [(k, (t or "").split("\n")) for k, t in order]
    gone = {k: set() for k, _ in order}
    places = [(a, i) for a, (_, x) in enumerate(lines) for i in range(len(x))]
    for a, i in places:
        for b, j in places:
            if (b, j) < (a, i):
                x, y, n, words = lines[a][1], lines[b][1], 0, 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    words += len(x[i + n].encode().split())
                    n += 1
                if words >= least:
                    gone[lines[a][0]].update(range(i, i + n))
    return {k: (len(x), len(gone[k]), hashlib.sha256("\n".join(v for n, v in enumerate(x) if n not in gone[k]).encode()).hexdigest()) for k, x in lines}


@pytest.mark.parametrize("seed", range(3))
def test_runs_match_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 4))) for _ in range(7)] + ["é ü\r"]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))) for i in range(25)]
    docs += [(30 + i, docs[i][1]) for i in range(4)] + [(50, None), (51, ""), (None, docs[6][1]), (52, "z " * 20), (53, "z " * 20), (54, "\n" * 40 + docs[7][1])]
    d = spark.createDataFrame([(*x, 1, "n") for x in docs], "doc_id long, text string, h int, name string")
    out = line_dedup.delete_repeated_runs(d, 8)
    assert out.columns == [*d.columns, "__lines", "__removed"]
    assert {x.doc_id: (x["__lines"], x["__removed"], hashlib.sha256((x.text or "").encode()).hexdigest()) for x in out.collect()} == plain_runs(docs, 8)


def test_runs_of_repeated_rows_and_long_texts(spark):
    long = "\n".join("line %d of a text" % i for i in range(3000))
    rows = [(1, long), (1, long), (2, long + "\nown end"), (3, "a\n" * 500)]
    got = {}
    for x in line_dedup.delete_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x.doc_id, []).append(x["__removed"])
    assert got == {1: [0, 0], 2: [3000], 3: [499]}  # overlapping its own first copy, which is all that stays
    assert line_dedup.delete_repeated_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
