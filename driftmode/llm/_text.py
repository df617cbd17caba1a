"""Vectorised text kernels shared by the operators of this subpackage.

Texts stay in their Arrow buffers: word borders, 64-bit word hashes and window hashes are
NumPy passes over the bytes of a block of rows, so no Python object exists per word.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call takes; a longer single text makes a block of its own.
BLOCK_BYTES = 4 << 20

_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)
_LONG_WORD = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _ALNUM[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def freed(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run``, after which a Python worker, which outlives its task, gives unused memory back to the system."""

    @functools.wraps(run)
    def wrapped(*args):
        yield from run(*args)
        release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def parts(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about ``limit`` bytes in a text or binary column (or one row)."""
    arr = batch.column(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (wraps around)."""
    x = (x ^ (x >> _S32)) * _C1
    x = (x ^ (x >> _S29)) * _C2
    return x ^ (x >> _S32)


def uniform(x: np.ndarray) -> np.ndarray:
    """Hash values to doubles in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / 9007199254740992.0


@dataclass
class Block:
    """Bytes of some rows, one after another; row ``i`` is ``buf[off[i]:off[i + 1]]``. ``first`` is its place in the batch."""

    buf: np.ndarray
    off: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A contiguous large-string array; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string())


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of at most ``limit`` bytes (or one row)."""
    arr = text_array(column)
    n = len(arr)
    if not n:
        return
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield Block(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


@dataclass
class Words:
    """Words of a block: byte ranges ``start:end`` into ``buf``, and ``off``: row ``i`` owns words ``off[i]:off[i + 1]``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word's bytes."""
        n = len(self.start)
        if not n:
            return np.zeros(0, np.uint64)
        padded = np.zeros(len(self.buf) + 8, np.uint8)
        padded[: len(self.buf)] = self.buf
        eights = np.ndarray((len(self.buf) + 1,), "<u8", padded, strides=(1,))
        size = self.end - self.start
        h = mix((eights[self.start] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _C2)
        left = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
        at = 8
        while len(left):
            rest = size[left] - at
            h[left] = mix(h[left] * _C1 + (eights[self.start[left] + at] & _MASK[np.minimum(rest, 8)]))
            at += 8
            left = left[rest > 8]
        for i in np.flatnonzero(size > _LONG_WORD):
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return h


def words(block: Block, kind: str = "space") -> Words:
    """Words of each row. ``space``: runs of bytes other than white space (0x20, 0x09-0x0D).
    ``alnum``: A-Z are lowered, then runs of a-z, 0-9 and non-ASCII characters."""
    buf = block.buf
    if kind == "alnum":
        buf = _LOWER[buf]
        inside = _ALNUM[buf]
    else:
        inside = ~_SPACE[buf]
    n = len(buf)
    if not n:
        return Words(buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block.off), np.int64))
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = block.off[:-1]
    before[edge[edge < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edge = block.off[1:] - 1
    after[edge[edge >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(buf, start, end, np.searchsorted(start, block.off))


def windows(h: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` consecutive words inside a row, and the word at which each begins."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[: n - size + 1].copy()
    for k in range(1, size):
        out = mix(out) + h[k : n - size + 1 + k]
    room = np.zeros(n - size + 1, bool)
    last = np.repeat(off[1:], np.diff(off))[: n - size + 1]
    at = np.arange(n - size + 1)
    room = at + size <= last
    at = at[room]
    return mix(out[room]), at


def code_points(buf: np.ndarray) -> np.ndarray:
    """True at the first byte of every UTF-8 character."""
    return (buf & 0xC0) != 0x80


def counts_in_rows(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each row's range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, as ascending disjoint spans (touching ones are joined)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return s[first], e[last]
