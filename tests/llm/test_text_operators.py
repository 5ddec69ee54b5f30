"""Operators on single texts against plain versions: licences, quality rules, SentencePiece, packing, URL filters."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import license_scan, quality_rules, sentencepiece_codec, token_packing, url_filter

ODD = ["", None, " ", "\n\n", "a", "é Ü ß", "日本語 text", "x" * 5000, "word " * 3000, "tab\tand\x0bvertical\r\nlines\n", "\x00 nul", "  two  spaces ", "▁ mark", "All rights RESERVED."]


def documents(spark, texts, extra="words string"):
    """Rows with a null doc_id, a repeated row and an extra column whose name an operator uses itself."""
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "x") for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "null id", None, None, None, None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="module")
def sample(sf_dir):
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id LIMIT 150").fetchall()]


# --- SentencePiece


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.PieceModel(sentencepiece_codec.model_bytes(sentencepiece_codec.default_model_path()))


def fuzz(n=1500, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(" ab▁\n\té日😀<0xE3>thein") for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_ids_and_text_equal_the_library(model, sample):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model_path())
    for t in [*sample, *fuzz(), *(t or "" for t in ODD)]:
        ids = lib.encode(t, add_eos=True)
        n, a, b, c = model.digest(t)
        text = lib.decode(ids)
        own, _, spans = model.encode_spans(t)  # without the cache
        assert own == ids[:-1] and c == hashlib.sha256(np.array([*[x for x, _ in spans], *[y for _, y in spans]], "<i4").tobytes()).hexdigest()
        assert (n, a, b) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert model.decode(ids) == text


def test_spans_cover_the_text(model):
    for t in ["Hello  wörld", "日本 a", *fuzz(200, 2)]:
        ids, pieces, spans = model.encode_spans(t)
        assert len(ids) == len(pieces) == len(spans)
        data = t.encode()
        assert not spans or (spans[0][0] == 0 and spans[-1][1] == len(data))
        assert all(a[1] == b[0] or a == b for a, b in zip(spans, spans[1:]))


def test_tiny_cache_and_long_chunks_give_the_same(model, sample):
    small = sentencepiece_codec.PieceModel(sentencepiece_codec.model_bytes(sentencepiece_codec.default_model_path()), cache_size=10)
    for t in [*sample[:30], "y" * 3000]:
        assert small.digest(t) == model.digest(t)


def charsmap(entries):
    """A compiled map built for the test: a double array, one state after another, and replacements."""
    units, used, strings = {0: 0}, {0}, b""
    tree: dict = {}
    for k, v in entries.items():
        node = tree
        for b in k:
            node = node.setdefault(b, {})
        node[None] = v

    def place(node, at):
        nonlocal strings
        keys = [0 if k is None else k for k in node]
        base = next(o for o in range(1, 5000) if not any((at ^ o ^ k) in used for k in keys) and (at ^ o) not in used)
        units[at] = units.get(at, 0) | base << 10
        used.add(at ^ base)
        for k in keys:
            used.add(at ^ base ^ k)
        for k, child in node.items():
            to = at ^ base ^ (0 if k is None else k)
            if k is None:
                units[at] |= 1 << 8
                units[to] = len(strings) | 1 << 31
                strings += child + b"\0"
            else:
                units[to] = k
                place(child, to)

    place(tree, 0)
    table = b"".join(units.get(i, 0).to_bytes(4, "little") for i in range(max(units) + 1))
    return len(table).to_bytes(4, "little") + table + strings


def test_longest_prefix_normalisation_records_sources(model):
    m = sentencepiece_codec.PieceModel(sentencepiece_codec.model_bytes(sentencepiece_codec.default_model_path()))
    m.map = sentencepiece_codec.CharsMap(charsmap({"ﬁ".encode(): b"fi", b"a": b"A", b"ab": b"B", "é".encode(): "e\u0301".encode()}))
    m.plain = m.identity = False
    assert m.normalize("abaﬁé x") == ("▁BAfie\u0301▁x", [0, 0, 0, 0, 2, 3, 3, 6, 6, 6, 8, 8, 8, 9, 10])
    ids, _, spans = m.encode_spans("ﬁ a")
    assert spans[0][0] == 0 and spans[-1][1] == 5 and m.decode(ids) == "fi A"
    m.remove_extra = True
    assert m.normalize("  ab   a ")[0] == "▁B▁A"


def test_encoding_table(spark):
    got = sentencepiece_codec.encode_digests(documents(spark, ODD), sentencepiece_codec.default_model_path()).collect()
    assert len(got) == len(ODD) + 2
    empty = [r for r in got if r.doc_id in (0, 1)]
    assert all(r.n_tokens == 1 and r.decoded_sha256 == hashlib.sha256(b"").hexdigest() for r in empty)
    spans = sentencepiece_codec.encode_with_spans(documents(spark, ["ab cd", None]), sentencepiece_codec.default_model_path())
    assert {r.doc_id: r.ends[-1] if r.ends else 0 for r in spans.collect()}[0] == 5


# --- licences


def plain_licenses(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    found = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def test_licenses_match_brute_force(spark, sample):
    texts = [*ODD, *sample[:60], "CC BY cc-by  x GENERAL public\nlicense", "cc", "by cc by", "the mit license", "Released under the MIT License.", "all rights all rights reserved", "public license general", "\u212a cc by"]
    d = documents(spark, texts, "places string")
    got = license_scan.scan_licenses(d).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(texts):
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(t), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert by[texts.index("Released under the MIT License.")].labels == "mit" and by[texts.index("cc")].labels == ""
    assert license_scan.scan_licenses(d.limit(0)).count() == 0


def test_license_labels_match_brute_force(spark, sample):
    full = [t for t, *_ in license_scan.TEMPLATES]
    cut = [" ".join(w for i, w in enumerate(t.split()) if i % 3 or i < 9) for t in full]
    texts = [*sample[:40], *full, *cut, " ".join(full), "x " * 700 + full[6], "mit license " * 300, "license " * 2000, "", None]
    words = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) for t in texts]
    templates = [(p.split(), p.split(), label) for p, label in license_scan.BASE] + [(t.split(), k.split(), label) for t, k, label in license_scan.TEMPLATES]
    idf = {w: math.log((len(texts) + 1) / (sum(w in x for x in words) + 1)) + 0.01 for t, *_ in templates for w in t}
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, x in enumerate(words):
        labels, best = set(), 0.0
        for t, key, label in templates:
            k = next(j for j in range(len(t)) if t[j : j + len(key)] == key)
            for at in range(len(x)):
                if x[at : at + len(key)] == key:
                    share = sum(idf[w] for j, w in enumerate(t) if 0 <= at - k + j < len(x) and x[at - k + j] == w) / sum(idf[w] for w in t)
                    if share >= license_scan.MIN_SCORE:
                        labels.add(label)
                        best = max(best, min(1.0, share))
        assert got[i].labels == ",".join(sorted(labels)), texts[i]
        assert got[i].score == pytest.approx(best, abs=2e-6)


# --- quality rules


def plain_quality(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered |= set(range(i, i + 8))
    seen, twice = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\f\r"):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(covered)


def test_quality_matches_brute_force(spark, sample):
    r = random.Random(3)
    texts = [*ODD, *sample, "a b c d e f g h " * 2, "x\nx\n \n \nx", *[" ".join(r.choice("ab") for _ in range(40)) for _ in range(20)]]
    got = quality_rules.judge_quality(documents(spark, texts, "hash string"), min_words=20).collect()
    assert len(got) == len(texts) + 2
    by = {x.doc_id: x for x in got if x.doc_id is not None}
    for i, t in enumerate(texts):
        x, want = by[i], plain_quality(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, t
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (x.base_failed and x.kept)
    assert quality_rules.judge_quality(documents(spark, ["a"]).limit(0)).count() == 0


def test_jensen_shannon(spark):
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.9, 0.1], [0.5, 0.5])], "p array<double>, q array<double>")
    got = [x[0] for x in d.select(quality_rules.jensen_shannon("p", "q")).collect()]
    p, q = np.array([0.9, 0.1]), np.array([0.5, 0.5])
    m = (p + q) / 2
    assert got == pytest.approx([1, 0, np.sqrt((p @ np.log2(p / m) + q @ np.log2(q / m)) / 2)])


def test_no_python_in_native_plans(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for out in (license_scan.scan_licenses(d), quality_rules.judge_quality(d)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- packing


def test_best_fit_decreasing_matches_a_plain_search():
    r = random.Random(0)
    for _ in range(200):
        length = r.choice([8, 16, 33])
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 60))]
        rows = token_packing.best_fit_decreasing(sizes, length)
        free = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [(f, j) for j, f in enumerate(free) if f >= sizes[i]]
            if fit:
                free[min(fit)[1]] -= sizes[i]
            else:
                free.append(length - sizes[i])
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in row) for row in rows) == sorted(free)


def test_packing_round_trip(spark):
    texts = [*ODD, "long " * 2000]
    rows = [(i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    encode = lambda t: np.frombuffer(t.encode(), np.uint8).astype(np.uint32)
    for window in (100, 10**6):
        out = [tuple(r) for r in token_packing.pack_documents(d, lambda: encode, end=256, length=64, window=window).collect()]
        got = token_packing.unpack(out)
        assert all(np.array_equal(got[i], np.append(encode(t or ""), 256)) for i, t in rows)
        assert all(len(r[7]) == 128 and r[1] == r[5][-1] <= 64 and r[6] == r[5][:-1] for r in out)
        assert len({r[0] for r in out}) == len(out)
    assert token_packing.pack_documents(d.limit(0), lambda: encode, end=256).count() == 0


def test_packed_rows_are_full(spark, sf_dir):
    rows = token_packing.op3_token_packing(spark, sf_dir).selectExpr("avg(n_tokens) / 2048 f").first()
    assert rows.f > 0.97


# --- urls

URLS = [
    "http://A.Example.NET/en/x", "http://example.net/de/", "http://net", "http://x.net/", "https://b.example.com/de/1?q", "http://example.com/en", "http://c.org/fr/", "http://spam.shop.example.org/en/", "http://ok.org/", "no scheme", None, "",
    "a://b://c/d", "http://www.cheap-pills.io#x", "http://notexample.com/de/", "ftp://example.com:80/de/", "http://net?x", "http://cheap.io/", "HTTP://Xn--É.org/fr/é",
]


def plain_url(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url[url.index("://") + 3 :]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    keys = [host.split(".", i)[-1] for i in range(host.count(".") + 1)] if host else []
    listed = any(set(k.split(".")[0].split("-")) & set(url_filter.LISTED_WORDS) for k in keys)
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "block" if listed else "allow"


def test_urls_match_brute_force(spark):
    d = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(URLS)] + [(3, URLS[3], "h", "k")], "page_id long, url string, host string, key string")
    for most in (4_000_000, 3, 1):  # with small ones the keys are dealt into several shards
        got = url_filter.judge_urls(d, url_filter.default_list(d), max_keys=most).collect()
        assert len(got) == len(URLS) + 1
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain_url(u) for i, u in enumerate(URLS)}
    assert url_filter.judge_urls(d.limit(0), url_filter.default_list(d.limit(0))).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) key", "id % 7 = 0 listed")
    c = url_filter.build_cascade(keys.select(*url_filter._hashes(keys["key"]), "listed"), bits_per_key=3, probes=2)  # so that levels have false positives
    assert len(c.levels) > 2
    rows = keys.select(*url_filter._hashes(keys["key"]), "listed").toPandas()
    got = c.member(rows.h1.to_numpy().view(np.uint64), rows.h2.to_numpy().view(np.uint64))
    assert (got == rows.listed.to_numpy()).all()


def test_own_list_and_sql(spark, sf_dir):
    d = spark.createDataFrame([(1, "http://a.bad.io/x"), (2, "http://good.io/"), (3, "http://bad.io.com/")], "page_id long, url string")
    got = url_filter.judge_urls(d, listed=spark.createDataFrame([("Bad.io",), (None,), ("unseen.org",)], "key string"))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow", 3: "allow"}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = sorted(map(str, c.sql(url_filter.ORACLE).project("page_id, host, path, rule, verdict, listed_host").fetchall()))
    assert sorted(str(tuple(r)) for r in url_filter.op7_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", "verdict", "listed_host").collect()) == want
