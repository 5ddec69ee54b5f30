"""Operator 5: language-model scores from log-frequency Bloom filters of quantised n-gram counts.

Counting. Tasks count the training documents' tokens and send partial counts by token; the totals N and V and, for the base
score, every token's exact count come from that table. The most frequent tokens (at most `head`, a bound on what is sent to all
executors) are known everywhere with exact counts. All other tokens and all bigrams are counted too, whatever their number.

Filters. A count c is quantised to q = 1 + floor(log2 c), and stands for REP(q), the mean of the counts that have that q. A
filter holds (n-gram, 1), ..., (n-gram, q); a count is read back by probing with 1, 2, ... until one is missing. The n-grams
are dealt by hash into shards of about `shard_tokens` training tokens, one filter each, as large as its entries need; a
bigram goes by its context, and a context with more tokens than that over several shards. So no filter grows with the corpus,
only their number does, and none is sent to all executors: texts are scored in chunks of about `chunk_tokens` tokens, each of
which asks every shard at once for the n-grams it needs. Requests and answers are arrays, one row for each chunk and shard.

Probabilities. P1(w) = (c(w) + 1) / (N' + V + 1) with N' the sum of the counts as they are read. After a context v,
P(w|v) = max(c(vw) - D, 0) / W(v) + D T(v) / W(v) P1(w), where T(v) is the number of tokens seen after v and W(v) the sum of
their counts as they are read: both are kept exactly beside the filter, so that the probabilities add up. After an unseen
context P(w|v) = P1(w). The end is a token, and the context of a text's first token. `score` is the sum of log10 P over a
text's tokens and its end.

The base score needs the exact counts of all tokens: those of the head are at hand, the others (each text's distinct ones
with their frequencies) meet the count table in a join, whose keys are rare tokens by construction.

Nulls count as empty texts, a null doc_id as training; other columns are ignored. Repeated rows are all counted and all scored.
Equally frequent tokens are in the head together or not at all. An empty table gives an empty result; if there is nothing to
learn from, N and V are 0 and every probability is 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, mix, raw_texts, settle, ship, table

DISCOUNT = 0.5
#: 24 bits an entry and 12 probes: an absent n-gram is taken for a present one about once in 70,000 times.
BITS_PER_ENTRY, PROBES = 24, 12
SHARD_TOKENS, CHUNK_TOKENS = 1 << 20, 1 << 18
#: Keys that are looked up in a filter at a time, so that what is computed of them stays in the processor's cache.
BLOCK = 1 << 15
END = b" "  # no token has white space
#: Salts of the hashes that place a context, spread a frequent one, name a context and name a single token.
PLACE, SPREAD, CONTEXT, SINGLE = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25))
#: What single tokens have in place of a context's name.
NO_CONTEXT = 0xFFFFFFFF


def held_out(key, modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    out = text.lower().split()  # of bytes: A-Z and ASCII white space only
    out.append(END)
    return out


def rep(q):
    """The count that a quantum stands for: 1, 2.5, 5.5, ...; 0 for 0."""
    return np.where(np.asarray(q) > 1, 1.5 * 2.0 ** (np.asarray(q) - 1.0) - 0.5, np.asarray(q, float))


def quanta_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1]  # 1 + floor(log2 c)


def _low(x: np.ndarray) -> np.ndarray:
    """The lower half of hashes; the name that stands for none is kept free."""
    return np.minimum(x & np.uint64(0xFFFFFFFF), np.uint64(NO_CONTEXT - 1)).astype(np.uint32)


class CountFilter:
    """Quantised counts of 32-bit keys behind a Bloom filter as large as its entries need."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def halves(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a level's probes of each key begin, and how far apart they are."""
        with np.errstate(over="ignore"):
            a = mix(keys.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return a & np.uint64(0xFFFFFFFF), (a >> np.uint64(32)) | np.uint64(1)

    @staticmethod
    def places(start: np.ndarray, step: np.ndarray, probe: int, bits: int) -> np.ndarray:
        x = start + np.uint64(probe) * step
        return x - x // np.uint64(bits) * np.uint64(bits)  # numpy divides by one number much faster than it takes a remainder

    @classmethod
    def build(cls, keys: np.ndarray, q: np.ndarray) -> CountFilter:
        words = np.zeros(max(1, -(-int(q.sum()) * BITS_PER_ENTRY // 64)), np.uint64)
        bits = np.zeros(len(words) * 64, bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            held = keys[q >= level]
            for at in range(0, len(held), BLOCK):
                start, step = cls.halves(held[at : at + BLOCK], level)
                for probe in range(PROBES):
                    bits[cls.places(start, step, probe, len(bits))] = True
        return cls(np.packbits(bits, bitorder="little").view(np.uint64))

    def quanta(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key: 0 if it isn't held, else found by one probe after another."""
        out, bits = np.zeros(len(keys), np.uint8), len(self.words) * 64
        for first in range(0, len(keys), BLOCK):
            at, level = np.arange(first, min(first + BLOCK, len(keys))), 0
            while len(at):
                level += 1
                start, step = self.halves(keys[at], level)
                for probe in range(PROBES):
                    place = self.places(start, step, probe, bits)
                    held = (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                    if not held.all():
                        at, start, step = at[held], start[held], step[held]
                out[at] = level
        return out


def pieces(texts: pa.Array, most: int = 1 << 23) -> Iterator[pa.Array]:
    """The texts in runs of about `most` bytes, so that a batch of long ones isn't held several times over."""
    starts = np.flatnonzero(np.diff(np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // most, prepend=-1)).tolist()
    for i, j in zip(starts, [*starts[1:], len(texts)]):
        yield texts.slice(i, j - i)


def count_tokens(docs: DataFrame, most: int = 1 << 23) -> DataFrame:
    """token, c over all rows of docs; about `most` bytes of text are taken at a time."""

    def run(batches):
        for b in batches:
            for texts in pieces(b.column(0).fill_null(""), most):
                words = pc.ascii_split_whitespace(pc.ascii_lower(texts)).flatten()
                words = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
                names, n = words.dictionary.cast(pa.string()), np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([names, pa.array([END.decode()], pa.string())]), pa.array(np.append(n, len(texts)), pa.int64())], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


class Head:
    """The most frequent tokens: their numbers, in the order of their counts, exact counts, and over how many shards each one's
    bigrams are dealt."""

    def __init__(self, names: list[bytes], counts: np.ndarray):
        self.ids = {t: i for i, t in enumerate(names)}
        self.counts = counts
        self.fans = np.ones(len(counts), np.int64)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))

    def deal(self, shard_tokens: int) -> None:
        self.fans = np.maximum(1, -(-self.counts // shard_tokens)).astype(np.int64)


def _bucket(c):
    return F.floor(F.log(1.1, c))


def take_head(counts: DataFrame, most: int) -> tuple[Head, int]:
    """The tokens from the least count on at which there are at most `most` of them, and that count's bucket."""
    sizes = {int(r.b): r.n for r in counts.groupBy(_bucket(F.col("c")).alias("b")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    for b in sorted(sizes, reverse=True):
        if total + sizes[b] > most:
            break
        total, least = total + sizes[b], b
    rows = counts.filter(_bucket(F.col("c")) >= least).toArrow()
    names, c = rows["token"].cast(pa.binary()).to_pylist(), rows["c"].to_numpy()
    order = sorted(range(len(names)), key=lambda i: (-c[i], names[i]))
    return Head([names[i] for i in order], c[order] if order else np.zeros(0, np.int64)), least


class Grams:
    """The distinct n-grams of some texts (lists of tokens): where each is held, under which name, and which token has which."""

    def __init__(self, texts: list[list[bytes]], head: Head, shards: int):
        words = pa.array(list(chain.from_iterable(texts)), pa.large_binary()).dictionary_encode()
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # bytes, much sooner than by to_pylist
        code = words.indices.to_numpy().astype(np.int64)
        before = np.concatenate([code[-1:], code[:-1]])
        before[self.starts[:-1]] = code[-1] if len(code) else 0  # each text's last token is its end
        self.code = code
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.distinct, repeat(42)), np.uint64, len(self.distinct))
        self.ids = head.of(self.distinct)
        n = max(1, len(self.distinct))
        pairs, self.pair_of = np.unique(before * n + code, return_inverse=True)
        v, w = pairs // n, pairs % n
        home = (mix(h ^ PLACE) % np.uint64(shards)).astype(np.int64)
        fan = np.where(self.ids >= 0, head.fans[np.maximum(self.ids, 0)] if len(head.fans) else 1, 1)
        self.hot = fan > 1
        with np.errstate(over="ignore"):
            self.pair_keys = _low(mix(mix(h[v]) + h[w] * np.uint64(0x9E3779B97F4A7C15)))
        self.pair_homes = (home[v] + (mix(h[w] ^ SPREAD) % fan[v].astype(np.uint64)).astype(np.int64)) % shards
        self.names, self.homes = _low(mix(h ^ CONTEXT)), home
        self.pair_names, self.pair_contexts, self.pair_tokens = self.names[v], v, w
        self.tail = np.flatnonzero(self.ids < 0)
        self.single_keys = _low(mix(h ^ SINGLE))
        self.contexts = np.flatnonzero(~self.hot & (np.bincount(v, minlength=len(self.distinct)) > 0))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Shard and key of all bigrams, then of all tokens outside the head."""
        return np.concatenate([self.pair_homes, self.homes[self.tail]]), np.concatenate([self.pair_keys, self.single_keys[self.tail]])


def _by_shard(homes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order by shard, and each shard's part of it."""
    order = np.argsort(homes.astype(np.uint16) if homes.max(initial=0) < 1 << 16 else homes, kind="stable")  # 16 bits are sorted by radix
    ordered = homes[order]
    at = np.flatnonzero(np.diff(ordered, prepend=-1))
    found, ends = ordered[at], [*at[1:].tolist(), len(order)]
    return order, [(s, slice(a, b)) for s, a, b in zip(found.tolist(), at.tolist(), ends)]


def _gathered(batches, most: int) -> Iterator[list[list[bytes]]]:
    """Token lists of about `most` tokens at a time."""
    held, size = [], 0
    for b in batches:
        for t in raw_texts(b):
            held.append(tokens(t))
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_grams(docs: DataFrame, head, shards: int, flush: int = 600_000) -> DataFrame:
    """Partial counts: shard, and as arrays of 32 bits the keys, the names of their contexts, and the counts."""

    def run(batches):
        for texts in _gathered(batches, flush):
            g = Grams(texts, head.value, shards)
            homes, keys = g.keys()
            names = np.concatenate([g.pair_names, np.full(len(g.tail), NO_CONTEXT, np.uint32)])
            n = np.concatenate([np.bincount(g.pair_of, minlength=len(g.pair_keys)), np.bincount(g.code, minlength=len(g.distinct))[g.tail]]).astype(np.uint32)
            order, parts = _by_shard(homes)
            keys, names, n = keys[order], names[order], n[order]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), *[pa.array([x[at].tobytes() for _, at in parts], pa.binary()) for x in (keys, names, n)]], ["shard", "keys", "names", "n"])

    return docs.select("text").mapInArrow(run, "shard int, keys binary, names binary, n binary")


def _array(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


SHARD_SCHEMA = "shard int, words binary, names binary, weights binary, types binary, hot array<int>, hot_weights array<double>, hot_types array<long>"


def build_shards(partial: DataFrame, hot_names) -> DataFrame:
    """One row for each shard: its filter; its contexts' names, sorted, with W and T; and its part of both for contexts that are
    dealt over several shards, whose names hot_names holds, sorted."""

    def run(t: pa.Table) -> pa.Table:
        hot = hot_names.value
        all_keys, n = _array(t["keys"], np.uint32), _array(t["n"], np.uint32)
        ordered = np.sort(all_keys.astype(np.uint64) << np.uint64(32) | np.arange(len(all_keys), dtype=np.uint64))
        keys, at = (ordered >> np.uint64(32)).astype(np.uint32), (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
        counts = np.add.reduceat(n[at].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        keys, names = keys[first], _array(t["names"], np.uint32)[at[first]]
        q = quanta_of(counts)
        own = names != NO_CONTEXT
        contexts, of = np.unique(names[own], return_inverse=True)
        weights, types = np.bincount(of, weights=rep(q[own]), minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
        is_hot = np.isin(contexts, hot)
        numbers = np.searchsorted(hot, contexts[is_hot])
        f = CountFilter.build(keys, q)
        row = ([t["shard"][0].as_py()], [f.words.tobytes()], [contexts.astype(np.uint32).tobytes()], [weights.astype(np.float32).tobytes()], [types.astype(np.uint32).tobytes()], [numbers.tolist()], [weights[is_hot].tolist()], [types[is_hot].tolist()])
        kinds = (pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in SHARD_SCHEMA.split(", ")])

    return partial.groupBy("shard").applyInArrow(run, SHARD_SCHEMA)


class Model:
    """What scoring needs everywhere: the head, the totals, and W and T of the contexts that lie in several shards, all bounded.
    The rest is in `shards`, a table."""

    def __init__(self, head: Head, n: int, v: int, read: float, shard_count: int, hot_names: np.ndarray, hot_weights: np.ndarray, hot_types: np.ndarray):
        self.head, self.n, self.v, self.read, self.shard_count = head, n, v, read, shard_count
        self.hot_names, self.hot_weights, self.hot_types = hot_names, hot_weights, hot_types


def train(docs: DataFrame, head_size: int = 1 << 18, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, Model, int, DataFrame]:
    """The table of token counts, the model, the bucket of counts at which its head begins, and the shards. docs: the training rows."""
    sc = docs.sparkSession.sparkContext
    counts = cut(count_tokens(docs), "token-counts")
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    head, least = take_head(counts, head_size)
    q = F.length(F.bin("c"))
    tail = counts.filter(_bucket(F.col("c")) < least).agg(F.sum(F.when(q > 1, F.lit(1.5) * F.pow(F.lit(2.0), q - 1) - 0.5).otherwise(F.lit(1.0)))).first()[0]
    shard_tokens = max(shard_tokens, (n or 0) >> 18)  # so that no more contexts are dealt over several shards than the head may have
    shard_count = max(1, -(-(n or 0) // shard_tokens))
    head.deal(shard_tokens)
    hot = [t for t, i in head.ids.items() if head.fans[i] > 1]
    h = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in hot), np.uint64, len(hot))
    hot_names = np.unique(_low(mix(h ^ CONTEXT)))
    shared, names = sc.broadcast(head), sc.broadcast(hot_names)
    shards = cut(build_shards(count_grams(docs, shared, shard_count), names), "gram-shards")
    weights, types = np.zeros(len(hot_names)), np.zeros(len(hot_names))
    if len(hot_names):
        parts = shards.select(F.explode(F.arrays_zip("hot", "hot_weights", "hot_types")).alias("x")).groupBy("x.hot").agg(F.sum("x.hot_weights").alias("w"), F.sum("x.hot_types").alias("t"))
        for r in parts.collect():  # at most as many as there are shards
            weights[r.hot], types[r.hot] = r.w, r.t
    read = float(head.counts.sum()) + float(tail or 0.0)
    return counts, Model(head, n or 0, v, read, shard_count, hot_names, weights, types), least, shards


PACKS = "chunk long, row long, doc_id array<long>, held_out array<boolean>, sizes array<int>, texts binary"


def pack(docs: DataFrame, chunks: int, size: int = 1 << 15) -> DataFrame:
    """Rows (doc_id, held_out, text) in packs of about `size` bytes of consecutive texts, compressed, since texts are most of
    what scoring shuffles. A pack's chunk comes from its place, not from its texts: copies of one text are dealt over all chunks.
    row numbers the first text; the others follow."""

    def run(batches):
        first = row = TaskContext.get().partitionId() << 33
        held, total = [], 0

        def out():
            ids, marks, texts = zip(*held)
            chunk = int(mix(np.array([first], np.uint64))[0] % np.uint64(chunks))
            columns = (pa.array([chunk], pa.int64()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.bool_())), pa.array([[len(x) for x in texts]], pa.list_(pa.int32())), pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary()))
            return pa.RecordBatch.from_arrays(list(columns), [x.split()[0] for x in PACKS.split(", ")])

        for b in batches:
            for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_texts(b)):
                held.append(x)
                row += 1
                total += len(x[2]) + 64  # rows without text count too
                if total >= size:
                    yield out()
                    held, total, first = [], 0, row
        if held:
            yield out()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, PACKS)


def unpack(t: pa.Table) -> tuple[list[int], list[int | None], list[bool], list[list[bytes]]]:
    """row, doc_id, held_out and tokens of the texts of a chunk's packs, in the order of their rows."""
    rows, ids, marks, out = [], [], [], []
    for p in t.sort_by("row").to_pylist():
        data = pa.decompress(p["texts"], sum(p["sizes"]), "zstd", asbytes=True)
        ends = np.cumsum([0, *p["sizes"]]).tolist()
        rows += range(p["row"], p["row"] + len(p["sizes"]))
        ids += p["doc_id"]
        marks += p["held_out"]
        out += [tokens(data[i:j]) for i, j in zip(ends, ends[1:])]
    return rows, ids, marks, out


REQUESTS = "chunk long, shard int, keys binary, names binary"
ANSWERS = "chunk long, shard int, q binary, weights binary, shares binary"
#: Steps in which a context's share of unseen tokens, D T / W, is told: so exactly the probabilities add up.
SHARE_STEPS = 65535


def _requests(g: Grams) -> list[tuple[int, bytes, bytes]]:
    homes, keys = g.keys()
    order, parts = _by_shard(homes)
    by = {s: [keys[order[at]].tobytes(), b""] for s, at in parts}
    order, parts = _by_shard(g.homes[g.contexts])
    for s, at in parts:
        by.setdefault(s, [b"", b""])[1] = g.names[g.contexts[order[at]]].tobytes()
    return [(s, *by[s]) for s in sorted(by)]


def _answers(g: Grams, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the bigrams and of the tail's tokens as they are read, and W and D T / W of all distinct tokens as contexts."""
    answers = answers.sort_by("shard")
    homes, keys = g.keys()
    read = np.zeros(len(keys))
    read[_by_shard(homes)[0]] = rep(_array(answers["q"], np.uint8))
    weights, shares = np.zeros(len(g.distinct)), np.zeros(len(g.distinct))
    order = g.contexts[_by_shard(g.homes[g.contexts])[0]]
    weights[order], shares[order] = _array(answers["weights"], np.float32), _array(answers["shares"], np.uint16) / SHARE_STEPS
    return read, weights, shares


def answer(requests: DataFrame, shards: DataFrame) -> DataFrame:
    """Each shard probes its filter for what the chunks ask."""

    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        keys, names = _array(asked["keys"], np.uint32), _array(asked["names"], np.uint32)
        q, weights, shares = np.zeros(len(keys), np.uint8), np.zeros(len(names), np.float32), np.zeros(len(names), np.uint16)
        if shard.num_rows and asked.num_rows:
            distinct, of = np.unique(keys, return_inverse=True)
            q = CountFilter(_array(shard["words"], np.uint64)).quanta(distinct)[of]
            held, w, t = (_array(shard[c], k) for c, k in (("names", np.uint32), ("weights", np.float32), ("types", np.uint32)))
            if len(held):
                asked_for, of = np.unique(names, return_inverse=True)
                at = np.minimum(np.searchsorted(held, asked_for), len(held) - 1)
                known = held[at] == asked_for
                share = np.round(SHARE_STEPS * DISCOUNT * t[at] / w[at]).astype(np.uint16)
                weights, shares = np.where(known, w[at], np.float32(0))[of], np.where(known, share, np.uint16(0))[of]
        a = np.cumsum([0, *[len(x) // 4 for x in asked["keys"].to_pylist()]])
        b = np.cumsum([0, *[len(x) // 4 for x in asked["names"].to_pylist()]])
        columns = [asked["chunk"], asked["shard"], pa.array([q[i:j].tobytes() for i, j in zip(a, a[1:])], pa.binary()), *[pa.array([x[i:j].tobytes() for i, j in zip(b, b[1:])], pa.binary()) for x in (weights, shares)]]
        return pa.Table.from_arrays(columns, names=["chunk", "shard", "q", "weights", "shares"])

    return requests.groupBy("shard").cogroup(shards.select("shard", "words", "names", "weights", "types").groupBy("shard")).applyInArrow(run, ANSWERS)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, score double, token array<string>, tf array<int>"


def score_chunk(m: Model, texts: list[list[bytes]], answers: pa.Table) -> list[tuple[int, int, float, float, Counter]]:
    """For each text's tokens (one at least): their number, known head tokens, these ones' part of the base score, log10
    probability, and the other tokens."""
    g = Grams(texts, m.head, m.shard_count)
    read, weights, shares = _answers(g, answers)
    if g.hot.any():
        at = np.searchsorted(m.hot_names, g.names[g.hot])
        weights[g.hot], shares[g.hot] = m.hot_weights[at], DISCOUNT * m.hot_types[at] / np.maximum(m.hot_weights[at], 1)
    inside = g.ids >= 0
    exact = np.where(inside, m.head.counts[np.maximum(g.ids, 0)] if len(m.head.counts) else 0, 0).astype(float)
    c = exact.copy()
    c[g.tail] = read[len(g.pair_keys) :]
    single = (c + 1) / (m.read + m.v + 1)
    w = weights[g.pair_contexts]
    seen = w > 0
    p = single[g.pair_tokens]
    pair = read[: len(g.pair_keys)]
    p[seen] = np.maximum(pair[seen] - DISCOUNT, 0) / w[seen] + shares[g.pair_contexts][seen] * p[seen]
    base, known = np.log10(exact + 1)[g.code], inside[g.code]
    at = g.starts[:-1]
    outside = np.flatnonzero(~known)
    cuts = np.searchsorted(outside, g.starts)
    others = [g.distinct[i] for i in g.code[outside].tolist()]
    sums = [np.add.reduceat(x, at).tolist() for x in (known.astype(np.int64), base, np.log10(np.minimum(p, 1.0))[g.pair_of])]
    return list(zip(np.diff(g.starts).tolist(), *sums, (Counter(others[i:j]) for i, j in zip(cuts, cuts[1:]))))


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2, head_size: int = 1 << 18, shard_tokens: int = SHARD_TOKENS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; learnt from rows not held out."""
    spark = docs.sparkSession
    ship(spark)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", modulus, remainder).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts, model, least, shards = train(marked.filter(~F.col("held_out")), head_size, shard_tokens)
    settle(spark)
    shared = spark.sparkContext.broadcast(model)
    chunks = 1 + int(1.2 * model.n) // chunk_tokens
    dealt = pack(marked, chunks)

    def ask(t: pa.Table) -> pa.Table:
        m: Model = shared.value
        rows = _requests(Grams(unpack(t)[3], m.head, m.shard_count))
        made = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))]
        return pa.Table.from_arrays([pa.array([t["chunk"][0].as_py()] * len(rows), pa.int64()), *made], names=["chunk", "shard", "keys", "names"])

    def score(t: pa.Table, answers: pa.Table) -> pa.Table:
        rows, ids, marks, texts = unpack(t)
        got = score_chunk(shared.value, texts, answers) if texts else []
        n, known, base, p, others = zip(*got) if got else [[]] * 5
        columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(p, pa.float64()), pa.array([[w.decode() for w in o] for o in others], pa.list_(pa.string())), pa.array([list(o.values()) for o in others], pa.list_(pa.int32()))]
        return pa.Table.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.bool_()), *columns], names=[x.split()[0] for x in SCORED.split(", ")])

    answers = answer(dealt.groupBy("chunk").applyInArrow(ask, REQUESTS), shards)
    scored = cut(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORED), "lm-scored")
    drop(shards)
    settle(spark)
    others = scored.select("row", F.explode(F.arrays_zip("token", "tf")).alias("x")).select("row", "x.token", "x.tf")
    found = others.join(counts.filter(_bucket(F.col("c")) < least), "token").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("base"), F.sum("tf").alias("known"))
    per_token = float(np.log10(model.n + model.v + 1))
    return scored.drop("token", "tf").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("base", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"), "score",
    )


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
