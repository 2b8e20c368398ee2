"""Byte-level BPE encoding and decoding by a monoid tree reduction.

An encoded span is an element of a monoid whose product joins two neighbours. A long piece is halved
until a leaf merges directly; ``join`` re-encodes a window around the boundary and accepts it once
both of its outer edges are stable. An edge between tokens ``x`` and ``y`` is stable when
``merge(x + y) == [x, y]``. A sequence of tokens all of whose neighbours are stable is the encoding
of its bytes, as merges happen in order of rank and any merge across an edge would also happen in the
two tokens alone; so tokens outside the window provably stay, and else the window grows. Decoding
concatenates bytes up the same tree.

Defined results: a null text encodes and decodes as the empty one, to no ids and no bytes; a piece
that is itself a token becomes that token; a piece of any length takes O(n log n) merges. Lone
surrogates, which UTF-8 cannot hold, become ``?``. Other columns stay, and an output replaces a
column of its name.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices

LEAF = 48
#: Pieces whose ids a worker remembers in each of two generations; the older one goes when the newer is full.
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge by lowest rank, leftmost first, until no neighbours form a token."""
    if len(piece) > LEAF:
        return merge_long(piece, ranks)
    parts = [piece[k : k + 1] for k in range(len(piece))]
    get, none = ranks.get, len(ranks) + (1 << 40)
    pair = [get(piece[k : k + 2], none) for k in range(len(piece) - 1)]
    while pair and (low := min(pair)) != none:
        at = pair.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pair[at]
        if at:
            pair[at - 1] = get(parts[at - 1] + parts[at], none)
        if at < len(pair):
            pair[at] = get(parts[at] + parts[at + 1], none)
    return parts


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same merges from a heap over a linked list: O(n log n)."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[k]: where the part that starts at k ends; 0 once merged away
    before = list(range(-1, n - 1))
    heap = []
    for k in range(n - 1):
        r = ranks.get(piece[k : k + 2])
        if r is not None:
            heap.append((r, k, k + 2))
    heapq.heapify(heap)

    def push(k: int) -> None:
        middle = end[k]
        if middle < n and (r := ranks.get(piece[k : end[middle]])) is not None:
            heapq.heappush(heap, (r, k, end[middle]))

    while heap:
        _, k, stop = heapq.heappop(heap)
        middle = end[k]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[k], end[middle] = stop, 0
        if stop < n:
            before[stop] = k
            push(k)
        if k:
            push(before[k])
    out, k = [], 0
    while k < n:
        out.append(piece[k : end[k]])
        k = end[k]
    return out


def of_ascii(pattern: str) -> str | None:
    """The pattern's like for ASCII texts in the faster module ``re``, letters and numbers spelled out; None if it has other properties."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        inside = part == "[" or inside and part != "]"
        if part[:2] in (r"\p", r"\P"):
            spelled = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}.get(part)
            if spelled is None:
                return None
            part = spelled if inside else f"[{spelled}]"
        out.append(part)
    return "".join(out)


class Codec:
    """Encodes and decodes with one rank file; remembers the ids of frequent pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.findall = regex.compile(pattern).findall
        plain = of_ascii(pattern)
        self.plain = re.compile(plain, re.ASCII).findall if plain else self.findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.stable = lru_cache(50_000)(lambda x, y: merge(x + y, ranks) == [x, y])
        self.older: dict[str, bytes] = {}
        codec = self

        class Pieces(dict):
            """Pieces' ids as the bytes of 32-bit integers, so that a text's are joined without a look at each."""

            def __missing__(self, piece: str) -> bytes:
                if len(self) >= REMEMBERED:
                    codec.older = dict(self)
                    self.clear()
                ids = codec.older.get(piece)
                if ids is None:
                    ids = np.array(codec.piece(piece.encode("utf-8", "replace")), np.int32).tobytes()
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF:
            return merge(piece, self.ranks)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The monoid's product: the encoding of the concatenated bytes."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            window = merge(b"".join(left[-a:] + right[:b]), self.ranks)
            fixed_a = a == len(left) or self.stable(left[-a - 1], window[0])
            fixed_b = b == len(right) or self.stable(window[-1], right[b])
            if fixed_a and fixed_b:
                return left[:-a] + window + right[b:]
            a = a if fixed_a else min(len(left), 2 * a)
            b = b if fixed_b else min(len(right), 2 * b)

    def piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else tuple(self.ranks[x] for x in self.tree(piece))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts = self.plain(text) if text.isascii() else self.findall(text)
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, parts)), np.int32)

    def decode(self, ids) -> bytes:
        """Concatenate up the tree: leaves of a thousand tokens, then neighbours."""
        spans = [b"".join(map(self.tokens.__getitem__, ids[k : k + 1024])) for k in range(0, len(ids), 1024)]
        while len(spans) > 1:
            spans = [b"".join(spans[k : k + 2]) for k in range(0, len(spans), 2)]
        return spans[0] if spans else b""


@lru_cache(2)
def codec(name: str, pattern: str) -> Codec:
    """One codec for a Python worker, from the rank file that Spark has sent to its node."""
    return Codec(read_ranks(SparkFiles.get(name)), pattern)


def send(df: DataFrame, path: str) -> str:
    """Ship the rank file to every executor; its size is fixed by the vocabulary."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the token ids of ``text`` by the rank file at ``path`` and the pre-token ``pattern``."""
    name = send(docs, path)

    @F.arrow_udf("array<int>")
    def encoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(name, pattern)
        for batch in parts:
            for part in slices(batch):
                each = [c.encode(x) for x in part.to_pylist()]
                flat = np.concatenate([np.zeros(0, np.int32), *each])
                yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(flat, pa.int32()))

    return docs.withColumn(ids, encoded(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes that ``ids`` stand for."""
    name = send(docs, path)

    @F.arrow_udf("binary")
    def decoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(name, pattern)
        for batch in parts:
            made, size = [], 0
            for x in batch:
                made.append(c.decode(x.values.drop_null().to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"")
                size += len(made[-1]) + 16
                if size > SLICE_BYTES:
                    yield pa.array(made, pa.binary())
                    made, size = [], 0
            yield pa.array(made, pa.binary())

    return docs.withColumn(out, decoded(F.col(ids)))
