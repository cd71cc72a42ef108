"""Array kernels over batches of whole texts.

A batch of strings becomes one array of code points; words, pre-tokens and n-grams are then
spans of that array, found and hashed for all texts at once instead of one Python object each.
"""

from __future__ import annotations

import os
import sys
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points handled at once; bounds a worker's memory, not what is read.
BATCH_CHARS = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other (Unicode properties)."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))
    for text, shift in ((low, 0), (high, 0xE000)):
        for pattern, code in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for m in regex.finditer(pattern, text):
                table[m.start() + shift : m.end() + shift] = code
    return table


@lru_cache(maxsize=1)
def blanks() -> np.ndarray:
    """True for code points at which str.split() splits."""
    table = classes() == SPACE
    table[0x1C:0x20] = True
    return table


def batches(texts: list[str], limit: int = BATCH_CHARS):
    """(from, to) ranges of texts with about `limit` code points each; a longer text is alone."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (one more than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


_table: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; one table, grown as needed."""
    if len(_table[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + n // 4, base, np.uint64)
            p[0] = 1
            _table[k] = np.multiply.accumulate(p)
    return _table[0][:n], _table[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Spans:
    """64-bit hashes of any spans of a sequence, after one pass over it."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        p, self._inverse = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(0x5BD1E995)) * p[:n], out=self._sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = BATCH_CHARS) -> np.ndarray:
    """Hashes of spans in order of their starts, as Spans gives them, over pieces of bounded size."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        out[at:to] = Spans(values[base : int(ends[to - 1])]).hash(starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def runs(inside: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that cross no text boundary."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[doc_starts] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def words(cp: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the white-space separated words, as str.split() gives them."""
    return runs(~blanks()[cp], doc_starts)


def alnum_words(cp: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the runs of letters and numbers."""
    c = classes()[cp]
    return runs((c == LETTER) | (c == NUMBER), doc_starts)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the given ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


def utf8_lengths(cp: np.ndarray) -> np.ndarray:
    return 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)


def single_threaded() -> None:
    """Keeps array libraries to the one core of a Spark task."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")


assert sys.byteorder == "little"
