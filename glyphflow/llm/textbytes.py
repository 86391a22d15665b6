"""Whole texts as byte arrays: batches, words and rolling hashes, vectorised over many documents at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: The six white-space bytes of the contracts: space and \t \n \v \f \r.
WHITE = b" \t\n\x0b\x0c\r"
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multiplier of the polynomial hashes (mod 2**64), and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A random 64-bit value for each byte.
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The column's UTF-8 bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], key: str, text: str = "text", most: int = 1 << 21) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(keys, -1 for null, and texts) of about ``most`` bytes: many short documents together, a longer one alone."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for k, t in zip(batch.column(key).to_pylist(), as_bytes(batch.column(text)), strict=True):
            if size and size + len(t) > most:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
            ids.append(-1 if k is None else k)
            texts.append(t)
            size += len(t) + 64
    if ids:
        yield np.array(ids, np.int64), texts


class _Powers:
    """Powers of BASE and of its inverse, kept and lengthened as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            up, down = np.full(size, BASE, np.uint64), np.full(size, BASE_INVERSE, np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            if size > 1 << 22:
                return up[:n], down[:n]  # of one very long text: not kept
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined lower-cased bytes (A-Z only), each word's start and end in them, and its document's index."""
    joined = _LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    inside = np.zeros(len(joined) + 2, np.int8)
    inside[1:-1] = ~_IS_WHITE[joined]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    return joined, start, end, np.searchsorted(first, start, "right") - 1


class SpanHashes:
    """64-bit hashes of any spans of some bytes, from one pass over them."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        up, self.down = _POWERS.to(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[:n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.total[end] - self.total[start]) * self.down[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for every span."""
    return SpanHashes(data).of(start, end)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Batches) -> Batches:
    """Gives a task's memory back to the system when it ends: workers live on and would keep what they once held."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied
