"""Vectorised tokenising and hashing of Arrow text columns.

Every function works on the UTF-8 bytes of many documents laid end to end, cut into chunks of bounded size,
so that memory follows the chunk (or the longest single text), never the partition.
A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
#: Bytes whose words are hashed at once; the tables for this are all that stays in memory.
BLOCK = 1 << 18

#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
P = np.uint64(_P)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    """A random-looking 64-bit value for each byte; A-Z share the value of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
    values[65:91] = values[97:123]
    return values


LETTER = _letters()

#: Bytes of words parted by white space: all but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words made of ASCII letters, digits and all characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The first BLOCK powers of the multiplier, and of its inverse."""
    out = []
    for base in (_P, _P_INV):
        steps = np.full(BLOCK, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _polynomial(data: np.ndarray) -> np.uint64:
    """The polynomial of one word of any length, BLOCK bytes at a time."""
    total, factor, step = 0, 1, pow(_P, BLOCK, 1 << 64)
    for at in range(0, len(data), BLOCK):
        part = LETTER[data[at : at + BLOCK]]
        total += int((part * _powers()[0][: len(part)]).sum(dtype=np.uint64)) * factor
        factor = factor * step % (1 << 64)
    return np.uint64(total % (1 << 64))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets): rows whose texts hold up to `limit` bytes, or one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@cache
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def giving_back(run: Callable) -> Callable:
    """`run`, a function over a task's batches, after which freed memory goes back to the system: workers stay for later
    tasks, and the allocators would keep what the largest of all tasks took."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return whole


class Words:
    """The words of the documents in a chunk.

    starts, ends: byte range of each word; first: index of each document's first word, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kept: np.ndarray):
        inside = kept[data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside
        first_bytes = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[first_bytes] = False
        after = np.zeros(len(data) + 1, dtype=bool)
        after[:-1] = inside
        after[first_bytes] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.data = data

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, A-Z taken as a-z."""
        powers, inverse = _powers()
        out, at = np.empty(len(self.starts), dtype=np.uint64), 0
        while at < len(out):
            begin = self.starts[at]
            end = int(np.searchsorted(self.ends, begin + BLOCK, side="right"))
            if end <= at:  # a word of more than BLOCK bytes
                out[at] = _polynomial(self.data[begin : self.ends[at]])
                at += 1
                continue
            letters = LETTER[self.data[begin : self.ends[end - 1]]]
            total = np.zeros(len(letters) + 1, dtype=np.uint64)
            np.cumsum(letters * powers[: len(letters)], out=total[1:])
            starts = self.starts[at:end] - begin
            out[at:end] = (total[self.ends[at:end] - begin] - total[starts]) * inverse[starts]
            at = end
        return mix(out)

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a document, and the index of each one's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    total = hashes[:m].copy()
    for j in range(1, n):
        total *= np.uint64(_P)
        total += hashes[j : j + m]
    ok = np.ones(m, dtype=bool)
    for j in range(1, n):  # a gram that would reach over the end of its document
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(ok)
    return mix(total[at] + np.uint64(n)), at


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys in a sorted table, and which of them are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [start, start+count): the range of each element, and the elements."""
    owner = np.repeat(np.arange(len(starts)), counts)
    base = np.cumsum(counts) - counts
    return owner, np.arange(int(counts.sum())) - base[owner] + starts[owner]
