"""Operator 1: offset-preserving SentencePiece encoding and decoding.

A text is normalised by the model's compiled character map: at each place the longest entry of its double-array trie is
replaced, and every output byte records the source bytes it came from. BPE merges then run over chunks of the normalised
text, and each piece is projected through that record to a byte span of the original text. Chunks begin where a word mark
follows another character; no piece of the vocabulary reaches over such a place (checked when the model loads), so chunks
are independent and their results, spans relative to the chunk included, can be kept in a cache of bounded size.

Nulls count as empty texts; an empty text has the end id only. Ties between merges go to the leftmost pair. Rows repeat
as they come, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import release, ship, table, texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NEVER = float("-inf")
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
SPAN_SCHEMA = "doc_id long, ids array<int>, pieces array<string>, begins array<int>, ends array<int>"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    i, n = 0, len(data)

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    while i < n:
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class CharsMap:
    """The compiled character map: a double-array trie over source bytes whose leaves point to replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest entry that begins at a byte offset."""
        units = self.units
        if not units:
            return None

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        node, found = offset(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if not found:
            return None
        start, length = found
        return self.strings[start : self.strings.index(b"\0", start)], length


class PieceModel:
    """A SentencePiece BPE model read from its file's bytes."""

    def __init__(self, blob: bytes, cache_size: int = 300_000):
        self.pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix = self.remove_extra = self.escape = True
        self.byte_fallback = self.mark_last = False
        kind, charsmap = 1, b""
        for number, value in _fields(blob):
            if number == 1:
                piece, score, type_ = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        type_ = v
                self.pieces.append((piece, score, type_))
            elif number == 2:
                for k, v in _fields(value):
                    if k == 3:
                        kind = v
                    elif k == 24:
                        self.mark_last = bool(v)
                    elif k == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for k, v in _fields(value):
                    if k == 2:
                        charsmap = v
                    elif k == 3:
                        self.dummy_prefix = bool(v)
                    elif k == 4:
                        self.remove_extra = bool(v)
                    elif k == 5:
                        self.escape = bool(v)
        if kind != 2 or self.mark_last or any(t == UNUSED for _, _, t in self.pieces):
            raise NotImplementedError("only BPE models with leading word marks and no unused pieces")
        self.map = CharsMap(charsmap)
        self.user = sorted((p.encode() for p, _, t in self.pieces if t == USER), key=len, reverse=True)
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        self.scores = {p: s for p, s, t in self.pieces if t in (NORMAL, USER)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unk = next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)
        self.end = next((i for i, (p, _, t) in enumerate(self.pieces) if t == CONTROL and p == "</s>"), -1)
        self.space = MARK if self.escape else " "
        self.decimals = {p: str(i) for p, i in self.ids.items()}
        self.identity = not charsmap and not self.user and not self.remove_extra
        #: Every chunk of a plain model's texts begins with a mark, which the cache's keys leave out.
        self.plain = not charsmap and not self.user and not self.remove_extra and self.dummy_prefix and self.escape
        whole = any(self.space in p.lstrip(self.space) for p in self.ids)
        self.chunks = re.compile("(?s).+") if whole or self.user else re.compile(f"{self.space}*[^{self.space}]+|{self.space}+")
        self.limit = cache_size
        self.known: dict[str, tuple[str, str, bytes]] = {}
        self.old: dict[str, tuple[str, str, bytes]] = {}

    def normalize(self, text: str) -> tuple[str, list[int]]:
        """The normalised text and, for each of its UTF-8 bytes and the end, the source byte it begins at."""
        data = text.encode()
        out, align = bytearray(), []
        space = self.space.encode()
        at, n = 0, len(data)

        def step(at: int) -> tuple[bytes, int]:
            for u in self.user:
                if data.startswith(u, at):
                    return u, len(u)
            found = self.map.longest(data, at)
            if found:
                return found
            b = data[at]
            size = 1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4
            return data[at : at + size], size

        if self.remove_extra:
            while at < n:
                got, size = step(at)
                if got.strip(b" "):
                    break
                at += size
        if at == n:
            return "", [n]
        if self.dummy_prefix:
            out += space
            align += [at] * len(space)
        prev = self.remove_extra
        while at < n:
            got, size = step(at)
            if prev:
                got = got.lstrip(b" ")
            if got:
                new = got.replace(b" ", space)
                out += new
                align += [at] * len(new)
                prev = self.remove_extra and got.endswith(b" ")
            at += size
        if self.remove_extra:
            while out.endswith(space):
                del out[-len(space) :]
                n = align[len(out)]
                del align[len(out) :]
        return out.decode(), [*align, n]

    def merge(self, chunk: str) -> list[str]:
        """BPE: the best-scored neighbouring pair merges first, the leftmost among equals."""
        symbols = list(chunk)
        if self.user:
            symbols, i = [], 0
            own = [u.decode() for u in self.user]
            while i < len(chunk):
                symbols.append(next((u for u in own if chunk.startswith(u, i)), chunk[i]))
                i += len(symbols[-1])
        scores, n = self.scores, len(symbols)
        if n < 100 and not self.user:
            get = scores.get
            near = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
            while near:
                best = max(near)
                if best == NEVER:
                    break
                i = near.index(best)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del near[i]
                if i:
                    near[i - 1] = get(symbols[i - 1] + symbols[i], NEVER)
                if i < len(near):
                    near[i] = get(symbols[i] + symbols[i + 1], NEVER)
            return symbols
        frozen = {u.decode() for u in self.user}
        prev, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and symbols[i] not in frozen and symbols[j] not in frozen:
                pair = symbols[i] + symbols[j]
                s = scores.get(pair)
                if s is not None:
                    heapq.heappush(heap, (-s, i, j, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != pair or after[i] != j:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = after[j]
            if after[j] >= 0:
                prev[after[j]] = i
            offer(prev[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def to_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_fallback else [self.unk]

    def learn(self, chunk: str) -> tuple[str, str, bytes]:
        """Of a plain model's chunk (less its leading mark): ids, as decimals; what they decode to inside a text; and for each id,
        in 16 bits, the bytes by which it moves the end on in the original text, the blank before the chunk included: 0 if it
        shares its character with the id before. The chunk goes through the aligned normaliser. Short chunks go into the cache."""
        if chunk in self.old:
            got = self.old[chunk]
        else:
            if self.identity and chunk.isascii():  # each byte is its own source, and the mark's the blank's
                norm, align = MARK + chunk, None
            else:
                norm, align = self.normalize(chunk.replace(MARK, " ")) if chunk else (MARK, [0] * (len(MARK.encode()) + 1))
            pieces = self.merge(norm)
            try:
                ids = " ".join([self.decimals[p] for p in pieces])
            except KeyError:
                got = self._learn_bytes(pieces, align or [*[0] * len(MARK.encode()), *range(len(chunk) + 1)])
            else:
                if align:
                    ends = [align[x] for x in accumulate([len(p.encode()) for p in pieces])]
                    widths = map(sub, ends, [-1, *ends])
                else:
                    widths = map(len, pieces)
                got = ids, norm.replace(MARK, " "), array("H", widths).tobytes()
        if len(chunk) <= 100:
            self.known[chunk] = got
        return got

    def _learn_bytes(self, pieces: list[str], align: list[int]) -> tuple[str, str, bytes]:
        """The same of pieces of which some have no id but those of their bytes."""
        ids, steps, at, before = [], array("H"), 0, -1
        for p in pieces:
            to = at + len(p.encode())
            own = self.to_ids(p)
            ids += own
            steps.extend([align[to] - before, *[0] * (len(own) - 1)])
            at, before = to, align[to]
        return " ".join(map(str, ids)), self.surface(ids), steps.tobytes()

    def chunk_results(self, chunks: list[str]) -> tuple[str, str, bytes]:
        """learn() of a text's chunks, joined. The cache has two generations of bounded size."""
        found = list(map(self.known.get, chunks))
        if None in found:
            for i, got in enumerate(found):
                if got is None:
                    found[i] = self.known.get(chunks[i]) or self.learn(chunks[i])
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        ids, surfaces, spans = zip(*found)
        return " ".join(ids), "".join(surfaces), b"".join(spans)

    def forget(self) -> None:
        """Empties the cache, which outlives no task."""
        self.known, self.old = {}, {}

    def encode_spans(self, text: str) -> tuple[list[int], list[str], list[tuple[int, int]]]:
        """Ids, pieces and byte spans of the original text; bytes of one character share its span."""
        norm, align = self.normalize(text)
        ids, pieces, spans, at = [], [], [], 0
        for c in self.chunks.findall(norm):
            for p in self.merge(c):
                to = at + len(p.encode())
                for i in self.to_ids(p):
                    ids.append(i)
                    pieces.append(p if i in (self.ids.get(p), self.unk) else self.pieces[i][0])
                    spans.append((align[at], align[to]))
                at = to
        return ids, pieces, spans

    def surface(self, ids: list[int]) -> str:
        """Text of the ids, word marks as spaces; runs of byte pieces are read as UTF-8, each wrong byte as U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + size]).decode())
                        i += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                run.append(int(piece[3:5], 16))
                continue
            flush()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                out.append(piece.replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        if self.dummy_prefix and text.startswith(" "):
            first = next((self.pieces[i] for i in ids if self.pieces[i][2] != CONTROL), ("", 0, 0))
            if first[0].startswith(MARK):
                text = text[1:]
        return text

    def digest(self, text: str) -> tuple[int, str, str, str]:
        """Number of ids with the end, hash of the ids, hash of the decoded text, hash of the spans: all begins, then all ends, as
        32-bit little-endian integers, the end id left out."""
        if not self.plain or MARK in text:
            ids, _, spans = self.encode_spans(text)
            places = np.array([*[a for a, _ in spans], *[b for _, b in spans]], "<i4")
            decoded, ids = self.decode(ids), " ".join(map(str, ids))
        elif not text:
            ids, decoded, places = "", "", np.zeros(0, "<i4")
        else:
            if "  " not in text and text[0] != " " and text[-1] != " ":
                chunks = text.split(" ")
            else:
                chunks = [c[len(MARK) :] for c in self.chunks.findall(MARK + text.replace(" ", MARK))]
            ids, decoded, steps = self.chunk_results(chunks)
            widths = np.frombuffer(steps, np.uint16).astype("<i4")
            ends = np.cumsum(widths, dtype="<i4") - 1  # no blank stands before the first chunk
            if not widths.all():
                widths = widths[np.maximum.accumulate(np.where(widths, np.arange(len(widths)), 0))]
            places = np.concatenate([ends - widths, ends])
            places[places < 0] = 0
            if decoded.startswith(" "):
                decoded = decoded[1:]
        ids = f"{ids} {self.end}" if ids else str(self.end)
        return ids.count(" ") + 1, *(hashlib.sha256(x).hexdigest() for x in (ids.encode(), decoded.encode(), places.tobytes()))


_MODELS: dict[int, PieceModel] = {}


def model_of(blob: bytes) -> PieceModel:
    """One model, with its cache, for each Python worker."""
    key = hash(blob)
    if key not in _MODELS:
        _MODELS[key] = PieceModel(blob)
    return _MODELS[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 of each row; the model file (a few hundred kB) is read on the driver."""
    ship(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches):
        m = model_of(blob.value)
        for b in batches:
            rows = [m.digest(t) for t in texts(b)]
            if rows:
                n, ids, decoded, spans = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(spans)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])
        m.forget()
        release()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, DIGEST_SCHEMA)


def encode_with_spans(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, pieces and the byte span of each piece in the original text."""
    ship(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches):
        m = model_of(blob.value)
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), texts(b)):
                ids, pieces, spans = m.encode_spans(t)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([pieces], pa.list_(pa.string())), pa.array([[s for s, _ in spans]], pa.list_(pa.int32())), pa.array([[e for _, e in spans]], pa.list_(pa.int32()))], ["doc_id", "ids", "pieces", "begins", "ends"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SPAN_SCHEMA)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), default_model_path())
