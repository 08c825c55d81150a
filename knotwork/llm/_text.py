"""Vectorised text primitives: a batch of strings becomes one array of code points, and words are spans of it.

Everything works on whole batches with numpy, so the cost per character is a few passes over an array and the cost per
word does not involve a Python object.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, U64), np.ones(1, U64)]

#: Code points below this have their random value and class in a table.
_TABLE = 0x3100


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64)."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_RANDOM = mix(np.arange(_TABLE, dtype=U64))


def _class(test: Callable[[str], bool]) -> np.ndarray:
    return np.fromiter((test(chr(c)) for c in range(_TABLE)), bool, _TABLE)


#: ASCII letters and everything beyond ASCII.
LETTERS = _class(lambda c: c >= "\x80" or c.isalpha())
#: LETTERS and ASCII digits.
WORDS = _class(lambda c: c >= "\x80" or c.isalnum())
#: Anything but white space.
CHUNKS = _class(lambda c: not c.isspace())


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


def batches(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters together; a longer text is a range of its own, and is never cut."""
    first = total = 0
    for k, t in enumerate(texts):
        if k > first and total + len(t) > limit:
            yield first, k
            first, total = k, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


class Codes:
    """The code points of some texts end to end, with hashes of spans in constant time a span."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=self.offsets[1:])
        self._sums: np.ndarray | None = None

    def member(self, table: np.ndarray) -> np.ndarray:
        if len(self.codes) and int(self.codes.max()) >= _TABLE:
            return np.where(self.codes < _TABLE, table[np.minimum(self.codes, _TABLE - 1)], True)
        return table[self.codes]

    def spans(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each maximal run of characters in the class; a run doesn't leave its text."""
        inside = self.member(table)
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before, after = np.empty(len(inside), bool), np.empty(len(inside), bool)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans; equal strings have equal hashes wherever they stand."""
        n = len(self.codes)
        powers, inverses = _power_tables(n + 1)
        if self._sums is None:
            values = _RANDOM[self.codes] if not n or int(self.codes.max()) < _TABLE else mix(self.codes.astype(U64))
            self._sums = np.zeros(n + 1, U64)
            np.cumsum(values * powers[:n], dtype=U64, out=self._sums[1:])
        h = (self._sums[ends] - self._sums[starts]) * inverses[starts]
        return mix(h ^ ((ends - starts).astype(U64) << U64(40)))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the place of a first occurrence, and the inverse."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(hashes, return_index=True, return_inverse=True)


def ngram_hashes(words: np.ndarray, docs: np.ndarray, n: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams with their texts, in text order; a text of fewer than n words, but of any, is one n-gram."""
    counts = np.bincount(docs, minlength=n_docs) if len(docs) else np.zeros(n_docs, np.int64)
    out, of = [], []
    m = len(words) - n + 1
    if m > 0:
        h = np.zeros(m, U64)
        for j in range(n):
            h = h * U64(0xD6E8FEB86659FD93) + words[j : j + m]
        inside = docs[:m] == docs[n - 1 :]
        out.append(mix(h[inside]))
        of.append(docs[:m][inside])
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.cumsum(counts) - counts
        h = np.zeros(len(short), U64)
        for j in range(n - 1):
            there = counts[short] > j
            h[there] = h[there] * U64(0xD6E8FEB86659FD93) + words[first[short[there]] + j]
        out.append(mix(h ^ mix(counts[short].astype(U64))))
        of.append(short)
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h, d = np.concatenate(out), np.concatenate(of)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


class Memo:
    """Values by 64-bit hash, kept within a task; emptied when it outgrows limit, so memory stays bounded."""

    def __init__(self, width: int = 1, limit: int = 500_000, dtype: type = np.float64):
        self.limit, self.width, self.dtype = limit, width, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, U64), np.zeros((0, self.width), self.dtype)

    def get(self, keys: np.ndarray, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Values of sorted distinct keys; compute gets the positions of those that are new and returns their values."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        result = np.empty((len(keys), self.width), self.dtype)
        result[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            result[new] = np.asarray(compute(new), self.dtype).reshape(len(new), self.width)
            if len(self.keys) + len(new) > self.limit:
                self.clear()
                at = np.zeros(len(keys), np.int64)
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.values = np.insert(self.values, at[new], result[new], axis=0)
        return result


def give_back() -> None:
    """Gives the machine what this process has freed; otherwise the allocators keep it while the worker waits or does something
    else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task over batches, which gives back what it has freed when it ends."""

    @wraps(run)
    def task(stream: Iterator) -> Iterator:
        try:
            yield from run(stream)
        finally:
            give_back()

    return task


_KEPT: dict[str, tuple[str, object]] = {}


def kept(name: str, run: str, make: Callable[[], object]) -> object:
    """make(), once a worker process for each run (a unique text); only the last one is kept.

    Workers serve many tasks, so what a memo has learned in one task is not computed again in the next.
    """
    if name not in _KEPT or _KEPT[name][0] != run:
        _KEPT.clear()
        _KEPT[name] = (run, make())
    return _KEPT[name][1]
