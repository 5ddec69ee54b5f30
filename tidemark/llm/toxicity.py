"""Operator 4: toxicity by a weighted finite-state pattern grammar.

A clause's words become tags (insult, threat, modal, target, negation, reported speech, other). Five small weighted
transducers read the tags: one weighs insults, one threats (a modal verb before a threatening one), one adds weight if the
clause has a target as well, one takes weight off what stands shortly after a negation, one off what follows a word of
reported speech. Their composition is one machine; the weight of a clause's path is the clause's score, and a text's
score is a logistic function of the sum of its clauses' scores and of the largest.

The lexicon's weights are learnt from labelled rows: words and word beginnings with the logarithm of their odds between
toxic and clean texts. A word counts once for each group of texts that share the smallest hash of their word pairs, so that
copies of one text don't make its words look telling. The logistic function is fitted to the same rows. Learning uses all
labelled training rows up to `sample`, beyond that a share of them, chosen by a hash of doc_id, of about that size.
Only texts are read: neither labels nor any other column are inputs of a score.

Nulls count as empty texts, which score as a text without a matching clause does. Rows repeat as they come, a null doc_id is
no held-out row; a doc_id with several labels is toxic if one says so; labels that are null are left out. If labels are
missing, the built-in word list and default coefficients are used. An empty table gives an empty result; other columns are
no input, and keep their names in without_toxic. Equal texts score alike, so no tie needs a rule.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from math import lgamma

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import release, ship, table, texts

INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, OTHER = range(7)
#: Insults that are known without learning, and the closed classes of the grammar.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting vermin imbecile".split()
CLASSES = {
    THREAT: "kill hurt destroy beat shoot stab burn hang murder strangle".split(),
    MODAL: "will shall should must gonna going".split(),
    TARGET: "you your yours they them their he she him her people du ihr dich euch sie vous toi tes vos usted ustedes ellos".split(),
    NEGATION: "not never no none nobody nicht kein keine nie pas jamais aucun nunca ningún ninguna".split(),
    REPORT: "said says say called wrote reported claimed quoted sagte schrieb behauptete dit disait écrit dijo escribió".split(),
}
TAG_OF = {w: tag for tag, words in CLASSES.items() for w in words}
DEFAULT_WEIGHT, LARGEST = 3.0, 7.0
BEGINNINGS = range(4, 8)
WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = ".!?;:\n"
FEATURES = ("sum", "largest")


class Transducer:
    """A deterministic weighted machine over tags: (state, tag) -> (state, factor on the tag's weight, weight added)."""

    def __init__(self, start, arcs, finals=None):
        self.start, self.arcs, self.finals = start, arcs, finals or {}

    def step(self, state, tag):
        return self.arcs.get((state, tag), (state, 1.0, 0.0))


def compose(machines: list[Transducer]) -> Transducer:
    """The product of the machines over the states that can be reached: factors multiply, added weights add up."""
    start = tuple(m.start for m in machines)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for tag in range(7):
            steps = [m.step(s, tag) for m, s in zip(machines, state)]
            to, factor = tuple(s[0] for s in steps), float(np.prod([s[1] for s in steps]))
            arcs[state, tag] = to, factor, sum(s[2] for s in steps)
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return Transducer(start, arcs, {s: sum(m.finals.get(x, 0.0) for m, x in zip(machines, s)) for s in seen})


def grammar() -> Transducer:
    insult = Transducer(0, {})  # an insult's own weight passes
    threat = Transducer("quiet", {("quiet", MODAL): ("will", 1.0, 0.0), ("will", THREAT): ("quiet", 1.0, 2.0), ("will", INSULT): ("quiet", 1.0, 0.0)})
    target = Transducer(0, {(0, TARGET): (1, 1.0, 0.0), (0, INSULT): (2, 1.0, 0.0), (0, THREAT): (2, 1.0, 0.0), (1, INSULT): (3, 1.0, 0.0), (1, THREAT): (3, 1.0, 0.0), (2, TARGET): (3, 1.0, 0.0)}, {3: 0.5})
    negation: dict = {(s, NEGATION): (3, 1.0, 0.0) for s in range(4)}
    for s in (1, 2, 3):
        negation |= {(s, t): (s - 1, 1.0, 0.0) for t in (OTHER, MODAL, TARGET, REPORT)}
        negation |= {(s, INSULT): (0, 0.6, 0.0), (s, THREAT): (0, 0.3, 0.0)}
    reported: dict = {(0, REPORT): (1, 1.0, 0.0), (1, INSULT): (1, 0.8, 0.0), (1, THREAT): (1, 0.6, 0.0)}
    return compose([insult, threat, target, Transducer(0, negation), Transducer(0, reported)])


class Grammar:
    """The composed machine with a lexicon; lexicon: word or beginning (with a `*` after it) -> weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.machine, self.lexicon = grammar(), lexicon
        self.finder = ahocorasick.Automaton()
        for k in [*lexicon, *CLASSES[THREAT]]:
            self.finder.add_word(k.rstrip("*"), k)
        self.finder.make_automaton()
        self.starts = {k[:-1]: w for k, w in lexicon.items() if k[-1] == "*"}

    def weight(self, word: str) -> float:
        w = self.lexicon.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) < n:
                break
            w = max(w, self.starts.get(word[:n], 0.0))
        return w

    def clause(self, text: str) -> float:
        arcs, state, total = self.machine.arcs, self.machine.start, 0.0
        for word in WORD.findall(text):
            own = self.weight(word)
            tag = INSULT if own else TAG_OF.get(word, OTHER)
            state, factor, added = arcs[state, tag]
            total += (own if own else 1.0 if tag == THREAT else 0.0) * factor + added
        return total + (self.machine.finals[state] if total else 0.0)

    def matches(self, text: str) -> tuple[float, float]:
        """Sum and maximum of the scores of the clauses that have a match."""
        text = text.lower()
        done, total, largest = 0, 0.0, 0.0
        for end, _ in self.finder.iter(text):
            if end < done:
                continue
            a = max(text.rfind(c, done, end) for c in CLAUSE_END) + 1 or done  # never further back, so that time is linear
            b = next((i for i in range(end + 1, len(text)) if text[i] in CLAUSE_END), len(text))
            score = self.clause(text[a:b])
            total, largest, done = total + score, max(largest, score), b
        return total, largest


def _inputs(total: np.ndarray, largest: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), largest / LARGEST], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> np.ndarray:
    """Newton's method over cells of n rows each; the constant isn't penalised."""
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (y - p)) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _group(words: list[str]) -> int:
    """Smallest hash of the text's word pairs: mostly the same for texts that are nearly equal."""
    return min((xxhash.xxh64_intdigest(f"{a} {b}".encode()) >> 1 for a, b in zip(words, words[1:])), default=0)


def _terms(words: Iterable[str]) -> set[str]:
    out = set(words)
    for w in list(out):
        out |= {w[:n] + "*" for n in BEGINNINGS if len(w) >= n}
    return {t for t in out if len(t) > 2}


def learn_lexicon(rows: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """rows: text, toxic. Terms of the toxic texts are found first; only these are counted in the clean ones."""
    least = max(3, round(0.004 * toxic))

    def of_toxic(batches):
        for b in batches:
            for t in texts(b):
                words = WORD.findall(t.lower())
                terms = list(_terms(words))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([_group(words)] * len(terms), pa.int64())], ["term", "set"])

    found = rows.filter("toxic = 1").select("text").mapInArrow(of_toxic, "term string, set long").groupBy("term").agg(F.countDistinct("set").alias("n"), F.count("*").alias("t")).filter(F.col("n") >= least)
    table_ = found.toArrow()
    counts = dict(zip(table_["term"].to_pylist(), table_["n"].to_pylist()))
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(counts))

    def of_clean(batches):
        seen: Counter = Counter()
        known = shared.value
        for b in batches:
            for t in texts(b):
                seen.update(_terms(WORD.findall(t.lower())) & known)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    table_ = rows.filter("toxic = 0").select("text").mapInArrow(of_clean, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    other = dict(zip(table_["term"].to_pylist(), table_["n"].to_pylist()))
    out = {}
    rate, tried = toxic / (toxic + clean), np.log(max(1000, 10 * len(counts)))
    for term, n in counts.items():
        c = other.get(term, 0)
        chance = lgamma(n + c + 1) - lgamma(n + 1) - lgamma(c + 1) + n * np.log(rate) + c * np.log(1 - rate)
        if chance + tried > 0:  # as many terms as were tried would have one like this by chance
            continue
        odds = float(np.log((n + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
        if odds >= 3.0:
            out[term] = min(odds, LARGEST)
    # a longer term says nothing where a beginning of it weighs as much
    return {t: w for t, w in out.items() if not any(len(t.rstrip("*")) >= k and t.rstrip("*")[:k] + "*" != t and out.get(t[:k] + "*", 0.0) >= w for k in BEGINNINGS)}


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, sample: int = 20_000) -> tuple[dict[str, float], list[float]]:
    """Lexicon and coefficients, from rows whose crc32(doc_id as text) mod modulus isn't remainder."""
    ship(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(F.crc32(F.col("doc_id").cast("string")) % modulus != remainder).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = marked.count()
    if known > sample:
        marked = marked.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / known))
    n = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    lexicon = {w: DEFAULT_WEIGHT for w in INSULTS}
    coefficients = [-4.0, 2.0, 3.0]
    if not n.get(1) or not n.get(0):
        return lexicon, coefficients
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id")  # at most about `sample` rows
    lexicon |= learn_lexicon(rows, n[1], n[0])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        g = Grammar(shared.value)
        cells: dict = defaultdict(lambda: [0, 0])
        for b in batches:
            for t, y in zip(texts(b), b.column(1).to_pylist()):
                total, largest = g.matches(t)
                cell = cells[round(min(total, 1000.0), 1), round(largest, 1)]
                cell[0] += 1
                cell[1] += y
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in cells]), pa.array([k[1] for k in cells]), pa.array([v[0] for v in cells.values()]), pa.array([v[1] for v in cells.values()])], ["total", "largest", "n", "y"])

    cells = rows.select("text", "toxic").mapInArrow(run, "total double, largest double, n long, y long").groupBy("total", "largest").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toArrow()
    got = {c: cells[c].to_numpy().astype(float) for c in ("total", "largest", "n", "y")}
    order = np.lexsort((got["largest"], got["total"]))
    total, largest, count, y = (got[c][order] for c in ("total", "largest", "n", "y"))
    return lexicon, fit_logistic(_inputs(total, largest), y / count, count).tolist()


_GRAMMARS: dict = {}


def _grammar_of(key: int, lexicon: dict[str, float]) -> Grammar:
    if key not in _GRAMMARS:
        _GRAMMARS.clear()
        _GRAMMARS[key] = Grammar(lexicon)
    return _GRAMMARS[key]


def score_texts(docs: DataFrame, columns: list[str], lexicon: dict[str, float], coefficients: list[float]) -> DataFrame:
    """The named columns with toxicity_sum, toxicity_largest, toxicity_score of each row's text."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((lexicon, np.array(coefficients)))
    picked = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    schema = StructType([*picked.schema.fields[:-1], *[StructField(f"toxicity_{c}", DoubleType()) for c in ("sum", "largest", "score")]])

    def run(batches):
        lex, w = shared.value
        g = _grammar_of(id(lex), lex)
        for b in batches:
            if b.num_rows:
                found = np.array([g.matches(t) for t in texts(b, "__text")]).reshape(-1, 2)
                p = 1 / (1 + np.exp(-np.clip(_inputs(found[:, 0], found[:, 1]) @ w, -30, 30)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(p)], [*b.schema.names[:-1], "toxicity_sum", "toxicity_largest", "toxicity_score"])

    return picked.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """The rows whose text scores below the limit, all columns kept."""
    lexicon, coefficients = learn(docs, labels, modulus, remainder)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, np.array(coefficients)))

    def run(batches):
        lex, w = shared.value
        g = _grammar_of(id(lex), lex)
        for b in batches:
            if b.num_rows:
                found = np.array([g.matches(t) for t in texts(b)]).reshape(-1, 2)
                p = 1 / (1 + np.exp(-np.clip(_inputs(found[:, 0], found[:, 1]) @ w, -30, 30)))
                yield b.filter(pa.array(p < limit))
        release()

    return docs.mapInArrow(run, docs.schema)


def judge_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    lexicon, coefficients = learn(docs, labels, modulus, remainder)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % modulus == remainder, F.lit(False)).alias("held_out"), "text")
    out = score_texts(marked, ["doc_id", "held_out"], lexicon, coefficients)
    return out.select("doc_id", "held_out", F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
