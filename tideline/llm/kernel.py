"""numpy kernels over blocks of UTF-8 texts.

A block is a run of rows of an Arrow string column. Words are runs of bytes of a
class; their 64-bit hashes come from one polynomial prefix hash over the block, so
no Python object is made for a word. Hashes are equal for equal words (with A-Z
folded to a-z where asked) and, for different words, collide with chance 2**-64.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
#: A block has at most so many bytes, or one text.
BLOCK_BYTES = 1 << 20


def fresh(df, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def byte_class(*keep: int) -> np.ndarray:
    """A table over the 256 byte values: True where the value is in ``keep``."""
    out = np.zeros(256, bool)
    out[list(keep)] = True
    return out


#: Words split at white space (0x20, 0x09-0x0D), and words of letters, digits and non-ASCII.
SPACED = ~byte_class(0x20, *range(0x09, 0x0E))
ALNUM = byte_class(*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mixer of 64-bit values (the splitmix64 finaliser)."""
    x = np.asarray(x, U) + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(2)
def _byte_values(fold: bool) -> np.ndarray:
    v = mix(np.arange(256, dtype=U), 77)
    if fold:
        v[0x41:0x5B] = v[0x61:0x7B]
    return v


# What a worker keeps between tasks: the operator it works for, and one named thing of it.
_owner: list[str] = [""]
_kept: list = [None, None]


def kept(name: str, build: Callable):
    """The thing of this name, built if the worker doesn't hold it; a worker holds one at a time."""
    if _kept[0] != name:
        _kept[:] = None, None
        _kept[:] = name, build()
    return _kept[1]


def _enter(owner: str) -> None:
    """A worker that turns to another operator forgets what it kept for the one before."""
    if _owner[0] != owner:
        _owner[0] = owner
        _kept[:] = None, None
        gc.collect()


def _leave() -> None:
    """Gives freed memory back to the system, as an idle worker shares its executor with others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def task(owner: str, run: Callable) -> Callable:
    """``run`` over Arrow batches as one operator's task: enters, and leaves however it ends."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(owner)
        try:
            yield from run(batches)
        finally:
            _leave()

    return bounded


_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_MULT, _INV)):
            a = np.full(m, base, U)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=U)
    return _powers[0][:n], _powers[1][:n]


class Block:
    """Some texts: ``buf`` their bytes on end, ``off`` where each begins (one more at the end)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self.n = len(off) - 1
        self._prefix: dict[bool, np.ndarray] = {}

    def prefix(self, fold: bool) -> np.ndarray:
        if fold not in self._prefix:
            pw, _ = _power(len(self.buf) + 1)
            h = np.empty(len(self.buf) + 1, U)
            h[0] = 0
            np.cumsum(_byte_values(fold)[self.buf] * pw[:-1], dtype=U, out=h[1:])
            self._prefix[fold] = h
        return self._prefix[fold]

    def spans(self, member: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and row of the runs of bytes of a class; texts (and ``cut``) part runs."""
        m = member[self.buf]
        first = m.copy()
        first[1:] &= ~m[:-1]
        begins = self.off[:-1][self.off[:-1] < self.off[1:]]
        first[begins] = m[begins]
        if cut is not None:
            first[cut] = m[cut]
        last = np.empty_like(first)
        if len(m):
            last[:-1] = m[:-1] & (~m[1:] | first[1:])
            last[-1] = m[-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        return s, e, np.searchsorted(self.off, s, side="right") - 1

    def hashes(self, s: np.ndarray, e: np.ndarray, fold: bool = True) -> np.ndarray:
        """The hash of each span."""
        h, (_, inv) = self.prefix(fold), _power(len(self.buf) + 1)
        return mix((h[e] - h[s]) * inv[s] + (e - s).astype(U))

    def counts(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(rows, minlength=self.n)

    def text(self, s: int, e: int) -> bytes:
        return self.buf[s:e].tobytes()


def block_of(texts: list[str | None]) -> Block:
    return next(iter(blocks(pa.array(texts, pa.string()), 1 << 62)))[1] if texts else Block(np.zeros(0, np.uint8), np.zeros(1, np.int64))


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[slice, Block]]:
    """The rows of a string column in order, as slices and their blocks. Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield slice(i, j), Block(data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def grams(h: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; only the first len-k+1 places of a row are whole."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U)
    for i in range(k):
        out = out * U(_MULT) + h[i : i + n]
    return mix(out, k)


def whole(rows: np.ndarray, k: int) -> np.ndarray:
    """Where k words in sequence are of one row."""
    n = max(0, len(rows) - k + 1)
    return rows[:n] == rows[k - 1 : k - 1 + n]
