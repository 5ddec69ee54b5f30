import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import near_copies as N
from tidemark.llm import simhash as S
from tidemark.llm.components import connected_components


def plain_fingerprint(text, k=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def texts(seed=0):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 60, 200]))) for _ in range(40)]
    out = list(base)
    for t in base[:20]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[r.randrange(len(v))] = "new"
            out.append(" ".join(v))
    return [*out, *base[:5], "", None, " \n ", "É A b", "é a B", "x " * 30_000]


def test_fingerprints_and_components_match_brute_force(spark):
    rows = [(i, t, "extra") for i, t in enumerate(texts())]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp, r.component_id) for r in S.near_duplicate_components(d).collect()}
    fps = {i: plain_fingerprint(t or "") for i, t, _ in rows}
    assert {i: f & (1 << 64) - 1 for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == roots(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)


@pytest.mark.parametrize("radius", [4, 8])
def test_large_buckets(spark, monkeypatch, radius):
    """Many distinct fingerprints about few centres: all ways of dividing are taken, and none loses a component."""
    monkeypatch.setattr(S, "SMALL_BUCKET", 2)
    r = random.Random(radius)
    fps = {0}
    for _ in range(12):
        c = r.getrandbits(64)
        for _ in range(30):
            x = c
            for b in r.sample(range(64), r.randint(0, radius)):
                x ^= 1 << b
            fps.add(x)
        for _ in range(10):  # equal in the upper half
            fps.add(c >> 32 << 32 | r.getrandbits(32))
    signed = [S._signed(x) for x in fps]
    got = {x.node: x.root for x in S.link_components(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, hot_bucket=5).collect()}
    want = roots(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= radius)
    assert {n: got.get(n, n) for n in signed} == want


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Spark plans by the size of what was exploded: under its default limit all probes went through the driver."""
    plans, write = [], S.cut

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString().split("\n")))
        return write(df, name)

    monkeypatch.setattr(S, "cut", kept)
    monkeypatch.setattr(S, "SMALL_BUCKET", 2)
    r = random.Random(3)
    near = {sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(80)}
    S.link_components(write(spark.createDataFrame([(S._signed(x),) for x in near], "fp long"), "few"), 4, hot_bucket=5)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    assert {"buckets", "hits", "links"} <= {name for name, _ in plans}
    for name, lines in plans:
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = []
                for x in lines[i + 1 :]:
                    if depth(x) <= depth(line):
                        break
                    below.append(x)
                assert not any("Generate explode" in x for x in below), (name, lines)


def test_thresholds_add_up_and_cover():
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500.0)
    for radius in (1, 4, 8):
        parts = S.plan_parts(1 << 18, both * 262.144, radius)
        assert len({b for bits, _ in parts for b in bits}) == sum(len(bits) for bits, _ in parts)
        assert sum(t + 1 for _, t in parts) == radius + 1


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + r.randrange(40), 200 + r.randrange(40)) for _ in range(50)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges for n in e}
    linked = {frozenset(e) for e in edges}
    assert {n: got.get(n, n) for n in nodes} == roots(nodes, lambda a, b: frozenset((a, b)) in linked)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(spark):
    r = random.Random(9)
    base = [" ".join("w%d" % r.randrange(5000) for _ in range(300)) for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(base)] + [(20 + i, t) for i, t in enumerate(base[:4])] + [(40, base[5].replace(base[5].split()[100], "other", 1)), (7, base[7]), (50, ""), (51, None), (None, base[9]), (None, "single text " * 30)]
    d = spark.createDataFrame([(*x, 1.5) for x in rows], "doc_id long, text string, root double")
    kept = N.without_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == [(False, i) for i in range(10)] + [(False, 50), (True, 0)]


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicate_components(d).count() == 0 and N.without_near_duplicates(d).count() == 0


def test_shared_boilerplate_is_no_copy(spark):
    rows = [(i, "x " * 260 + " ".join(f"w{i}_{k}" for k in range(200))) for i in range(4)]
    assert N.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4
    with pytest.raises(ValueError):
        N.without_near_duplicates(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, __h int"))


@pytest.mark.parametrize("hot, large", [(16, 8192), (2, 4)])
def test_groups_of_near_copies_match_brute_force(spark, hot, large):
    """Two large groups about a text each, whose members are more or less alike: also with buckets that are divided and dealt by salt."""
    r = random.Random(23)
    rows = []
    for g in range(2):
        base = [f"w{r.randrange(10**6)}" for _ in range(150)]
        for i in range(60):
            copy = list(base)
            for at in r.sample(range(150), r.choice([0, 1, 2, 3, 6, 9])):
                copy[at] = f"x{r.randrange(10**6)}"
            rows.append((1000 * g + i, " ".join(copy)))
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    groups = roots(shingles, lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]))
    kept = {x.doc_id for x in N.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hot_bucket=hot, large_bucket=large).collect()}
    want = set(groups.values())
    assert want <= kept and len(kept - want) <= 0.05 * (len(rows) - len(want))


def test_nearly_all_pairs_at_the_threshold_are_found(spark):
    """By brute force over the shingle sets: of pairs just over a Jaccard similarity of 0.8 nearly all lose their later text."""
    r = random.Random(17)
    rows = []
    for i in range(120):
        words = [f"w{r.randrange(10**6)}" for _ in range(304)]
        copy = list(words)
        for at in r.sample(range(5, 300, 6), 6):  # each change replaces five shingles of 300
            copy[at] = f"x{r.randrange(10**6)}"
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    alike = [i for i in range(120) if 0.8 <= len(shingles[i] & shingles[1000 + i]) / len(shingles[i] | shingles[1000 + i]) < 0.83]
    assert len(alike) == 120
    kept = {x.doc_id for x in N.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(120))
    assert len([i for i in alike if 1000 + i not in kept]) >= 0.9 * len(alike)
