"""Whole-batch text primitives on Arrow buffers.

Executors see a text column as one byte buffer plus offsets.  The helpers here
find words, hash them and hash runs of words with a few vectorised passes over
that buffer, so no Python object is made per word.  A *word* is a maximal run
of characters other than U+0020 and U+0009..U+000D, which in UTF-8 is a
maximal run of bytes other than those six values.

Hashes are 64-bit: every byte value is first replaced by a random 64-bit
number, then combined as a polynomial in an odd base modulo 2**64 and mixed.
They depend on the bytes alone, never on the process or the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
pa.set_memory_pool(pa.system_memory_pool())  # freed batches go back to the system, not to a pool of each idle worker
_M_MMAP_THRESHOLD, _M_TRIM_THRESHOLD = -3, -1
try:
    _libc = ctypes.CDLL(None)
    _libc.mallopt(_M_MMAP_THRESHOLD, 1 << 20)  # so do freed arrays of a MB and more
except (OSError, AttributeError):  # not glibc
    _libc = None


@contextlib.contextmanager
def roomy(size: int = 16 << 20) -> Iterator[None]:
    """Freed arrays up to ``size`` stay with the process inside, which spares the faults of fresh pages; all go back at the end."""
    if _libc is None:
        yield
        return
    for option in (_M_MMAP_THRESHOLD, _M_TRIM_THRESHOLD):
        _libc.mallopt(option, size)
    try:
        yield
    finally:
        _libc.mallopt(_M_MMAP_THRESHOLD, 1 << 20)
        _libc.mallopt(_M_TRIM_THRESHOLD, 1 << 17)
        _libc.malloc_trim(0)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALT = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of text handled at once; bounds the working memory of a task.
SLICE_BYTES = 1 << 19

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 4096)
        step = np.full(size, _BASE, U64)
        step[0] = 1
        back = np.full(size, _INVERSE, U64)
        back[0] = 1
        with np.errstate(over="ignore"):
            _powers, _inverses = np.multiply.accumulate(step), np.multiply.accumulate(back)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash of several aligned hash arrays; the order matters."""
    out = np.zeros(len(parts[0]), U64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix(out * U64(0x9FB21C651E98DF25) + p + U64(0x632BE59BD9B4E019))
    return out


@dataclass
class Texts:
    """A run of documents: row numbers, bytes, and where each one begins and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a run of documents, in order: byte span, document and hash of each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    counts: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """First word of each document, and one past the last word of all."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column (nulls count as empty) into runs of about ``limit`` bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


#: Every ASCII character that is neither a letter nor a digit.
IS_BREAK = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def prefix_hashes(t: Texts, w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash of its first ``size`` bytes, lower-cased) of each word longer than that."""
    at = np.flatnonzero(w.end - w.start > size)
    key = np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            key = key * U64(_BASE) + _SALT[LOWER[t.data[w.start[at] + k]]]
    return at, mix(key)


def words_of(t: Texts, lower: bool = False, breaks: np.ndarray = IS_SPACE) -> Words:
    data, offsets = t.data, t.offsets
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = np.ones(n + 1, bool)
    inside[:n] = ~breaks[data]
    inside[n] = False
    opens = inside[:n].copy()
    opens[1:] &= ~inside[: n - 1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    opens[cuts] = inside[cuts]
    closes = inside[:n].copy()
    closes[: n - 1] &= ~inside[1:n]
    back = cuts[cuts > 0] - 1
    closes[back] = inside[back]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    doc = np.repeat(np.arange(len(offsets) - 1), counts)
    powers, inverses = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum(_SALT[data] * powers[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(U64))
    return Words(start, end, doc, h, counts)


def window_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one document, and the word it begins at."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * U64(_BASE) + w.hash[k : k + n]
    return mix(out[at]), at


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a plain sort; much faster here than hashing)."""
    if not len(h):
        return h
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def run_lengths(begins: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(begins, total))


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row k holds the raw bytes of ``values[bounds[k]:bounds[k + 1]]``."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, np.int64) * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())
