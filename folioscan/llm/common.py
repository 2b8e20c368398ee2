"""Helpers shared by the operators: the shared folder, lineage cuts, and integer hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import cut, qualified, shared_dir, stored

__all__ = ["Hashed", "cut", "let", "mix32", "mix64", "qualified", "released", "shared_dir", "slices", "stored", "trim"]

#: Bytes of values that an operator takes from an Arrow batch at a time. The batch itself is bounded by Spark
#: (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB if nobody sets it), or is one row.
SLICE_BYTES = 4 << 20


def slices(batch: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of strings or binaries, each of about ``most`` bytes or one value."""
    if not len(batch):
        yield batch
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch), 0), np.int64) + 16)
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch[at:end]
        at = end


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` or a lambda in it uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trim() -> None:
    """Give a Python worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


@contextmanager
def released() -> Iterator[None]:
    """``trim`` at the end: idle workers outlive their task."""
    try:
        yield
    finally:
        import gc

        gc.collect()
        trim()


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint32 arrays (xor-shift and multiply, as in public 32-bit mixers)."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays (the splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed(dict):
    """word -> 64-bit hash, remembered for up to ``most`` words; then it starts afresh."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
