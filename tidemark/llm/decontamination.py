"""Operator 6: benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised (A-Z lower-cased, runs of white space to one space, none at the ends). An item of n
characters may differ by k = floor(error_rate * n) edits, so of its k + 1 pieces one at least stands unchanged in any
passage within k edits. An automaton finds all pieces in a text; each hit gives the diagonal on which the item would lie,
neighbouring diagonals make one window, and Myers' bit-parallel algorithm finds the least distance of the item to any
passage of the window. The pair is a match if that is at most k.

Items are taken in blocks of at most `block_chars` characters, one at a time, each sent to all tasks; there are as many passes
over the texts as blocks, one for any usual benchmark. Items under `min_chars` characters have no budget and match between
word borders only. Items without text match nothing. Equal items match alike, each under its own item_id, a null one
included; of passages at the same distance the first counts. Repeated rows give repeated matches, null and empty texts none,
empty tables an empty result; other columns are ignored, and kept by without_leaks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, release, ship, table, texts

ERROR_RATE, MIN_CHARS, BLOCK_CHARS = 0.05, 40, 4_000_000


def normalize(text: str) -> str:
    return b" ".join(text.encode().lower().split()).decode()  # of bytes: A-Z and ASCII white space only


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item cut into k + 1 pieces of nearly equal length: (offset, piece)."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' algorithm for one item; a Python integer holds the whole column of differences."""

    def __init__(self, item: str):
        self.n = len(item)
        self.full, self.top = (1 << self.n) - 1, 1 << (self.n - 1)
        self.places: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.places[c] |= 1 << i

    def best(self, text: str, enough: int = 0) -> tuple[int, int]:
        """Least distance of the item to any passage of the text, and where the first such passage ends."""
        up, down, score, best, where = self.full, 0, self.n, self.n, 0
        full, top, get = self.full, self.top, self.places.get
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | (~(xh | up) & full)
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, where = score, j + 1
                    if best <= enough:
                        break
            ph, mh = (ph << 1) & full, (mh << 1) & full
            up, down = mh | (~(xv | ph) & full), ph & xv
        return best, where


class Items:
    """A block of items with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, min_chars: int):
        self.items = items
        self.short = [len(t) < min_chars for _, t in items]
        self.budget = [0 if s else int(len(t) * error_rate) for s, (_, t) in zip(self.short, items)]
        self.patterns = [Pattern(t) for _, t in items]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, t) in enumerate(items):
            for offset, piece in pieces(t, self.budget[i]):
                where[piece].append((i, offset))
        self.finder = ahocorasick.Automaton()
        for piece, places in where.items():
            self.finder.add_word(piece, (len(piece), places))
        self.finder.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item's number, distance, end in the normalised text) of each item that matches."""
        text = normalize(text)
        diagonals: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.finder.iter(text):
            for i, offset in places:
                if not self.short[i] or not (text[end - size : end - size + 1] if end >= size else " ").isalnum() and not text[end + 1 : end + 2].isalnum():
                    diagonals[i].add(end + 1 - size - offset)
        out = []
        for i, found in diagonals.items():
            k, n = self.budget[i], self.patterns[i].n
            if self.short[i]:
                out.append((i, 0, min(found) + n))
                continue
            best, where, windows = k + 1, 0, []
            for d in sorted(found):
                a, b = max(0, d - k), d + n + k
                if windows and a <= windows[-1][2] + 2 * k:
                    windows[-1] = windows[-1][0], b, d
                else:
                    windows.append((a, b, d))
            for a, b, _ in windows:
                got, end = self.patterns[i].best(text[a:b])
                if got < best:
                    best, where = got, a + end
                if not best:
                    break
            if best <= k:
                out.append((i, best, where))
        return out


def item_blocks(items: DataFrame, block_chars: int) -> tuple[int, Iterator[list[tuple[int | None, str]]]]:
    """Number of blocks of bounded size, and the blocks of normalised items, one after another: only one is at hand at a time."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_chars))

    def blocks():
        for i in range(n):
            rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).select(F.col("item_id").cast("long"), F.col("text").cast("string")).collect()
            block = sorted({(r[0], t) for r in rows if (t := normalize(r[1] or ""))}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            if block:
                yield block

    return n, blocks()


def find_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget, ends_at: the pairs of a text and an item that it holds within the item's budget."""
    ship(docs.sparkSession)
    schema = "doc_id long, item_id long, distance int, budget int, ends_at long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    n, blocks = item_blocks(items, block_chars)
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            held = Items(shared.value, error_rate, min_chars)
            for b in batches:
                out = [(key, held.items[i][0], d, held.budget[i], end) for key, t in zip(b.column(0).to_pylist(), texts(b)) for i, d, end in held.search(t)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "distance", "budget", "ends_at"])

        part = rows.mapInArrow(run, schema)
        if n > 1:  # so that the block can go
            part = cut(part, "leaks")
            shared.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows whose text holds no item, all columns kept; decided in place, without a join."""
    ship(docs.sparkSession)
    out = docs
    n, blocks = item_blocks(items, block_chars)
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            held = Items(shared.value, error_rate, min_chars)
            for b in batches:
                yield b.filter(pa.array([not held.search(t) for t in texts(b)], pa.bool_()))
            release()

        before, out = out, out.mapInArrow(run, docs.schema)
        if n > 1:
            out = cut(out, "leak-free")
            shared.destroy()
            drop(before)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
