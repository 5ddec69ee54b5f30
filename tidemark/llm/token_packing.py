"""Operator 3: token ids packed into rows of fixed length.

Each text is tokenised and ended by an end id; a text longer than a row is split into segments of row length, losslessly.
Segments are packed by best-fit decreasing: in the order of falling length each goes to the row whose free space is the
smallest that suffices, which a segment tree over the possible free spaces finds in logarithmic time. A task packs what it
has read each time it holds `window` tokens and at its end, so memory is bounded and nothing is shuffled; which texts share
a row follows from the input's partitions, and a repeated task gives the same rows.

A packed row holds its ids as little-endian integers of 2 bytes (4 for larger vocabularies) padded with 0 to the row length,
so that a table of rows is an id matrix; the cumulative segment lengths; where positions restart; and for each segment its
doc_id and where in its text's ids it begins. unpack() is the exact inverse.

Nulls count as empty texts, which give one segment of the end id. Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import ship, table, texts

ROW_LENGTH, WINDOW_TOKENS = 2048, 2_000_000
SCHEMA = "row_id long, n_tokens int, n_segments int, doc_ids array<long>, begins array<long>, cu_seqlens array<int>, resets array<int>, ids binary"


class FreeSpace:
    """Rows by free space, with a segment tree that says which free spaces some row has."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        i = free + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least free space of `need` or more, removed, and that space."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i + (not self.tree[2 * i])
        free = i - self.size
        row = self.rows[free].pop()
        if not self.rows[free]:
            while i and not (i < self.size and (self.tree[2 * i] or self.tree[2 * i + 1])):
                self.tree[i] = 0
                i >>= 1
        return row, free


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of segment numbers; ties in size keep their order."""
    space, rows = FreeSpace(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = space.take(sizes[i])
        if found is None:
            rows.append([i])
            row, free = len(rows) - 1, length
        else:
            row, free = found
            rows[row].append(i)
        space.add(row, free - sizes[i])
    return rows


def pack(segments: list[tuple[int | None, int, np.ndarray]], length: int, kind: str, first_row: int) -> Iterator[tuple]:
    """Packed rows of segments (doc_id, where in the text's ids it begins, ids)."""
    for n, row in enumerate(best_fit_decreasing([len(s[2]) for s in segments], length)):
        parts = [segments[i] for i in row]
        sums = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])])
        ids = np.zeros(length, kind)
        ids[: sums[-1]] = np.concatenate([p[2] for p in parts])
        yield first_row + n, int(sums[-1]), len(parts), [p[0] for p in parts], [p[1] for p in parts], sums.tolist(), sums[:-1].tolist(), ids.tobytes()


def unpack(rows: list[tuple], kind: str = "<u2") -> dict:
    """doc_id -> ids, from packed rows in any order."""
    found: dict = {}
    for _, _, _, doc_ids, begins, sums, _, ids in rows:
        row = np.frombuffer(ids, kind)
        for d, at, a, b in zip(doc_ids, begins, sums, sums[1:]):
            found.setdefault(d, []).append((at, row[a:b]))
    return {d: np.concatenate([p for _, p in sorted(parts, key=lambda p: p[0])]) for d, parts in found.items()}


def pack_documents(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], end: int, length: int = ROW_LENGTH, window: int = WINDOW_TOKENS, kind: str = "<u2") -> DataFrame:
    """Packed rows of all texts. encoder is called once a task and gives a function from a text to its ids."""
    ship(docs.sparkSession)
    types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        encode, row = encoder(), TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        size = 0

        def out():
            nonlocal row
            made = list(pack(held, length, kind, row))
            row += len(made)
            held.clear()
            for at in range(0, len(made), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[at : at + 1000]), types)], names)

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), texts(b)):
                ids = np.append(encode(t), end).astype(kind)
                for at in range(0, len(ids), length):
                    held.append((key, at, ids[at : at + length]))
                size += len(ids)
                if size >= window:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    """Packed rows as a table at path."""
    rows.write.parquet(path)


_ENCODINGS: dict = {}


def byte_pair_encoder(ranks: bytes, pattern: str) -> Callable[[str], np.ndarray]:
    """A tokeniser from a file of ranks (base64 token, rank); special tokens' strings are ordinary text."""
    import tiktoken

    key = hash(ranks)
    if key not in _ENCODINGS:
        merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merged, special_tokens={})
    encoding = _ENCODINGS[key]
    return lambda text: np.asarray(encoding.encode_ordinary(text), dtype=np.uint32)


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))
    return pack_documents(table(spark, sf_dir, "documents"), lambda: byte_pair_encoder(*shared.value), end=50256)
