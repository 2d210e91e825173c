"""Text columns of Arrow batches as flat numpy arrays.

Every text operator of this subpackage works on slices of a batch: the texts
of a slice are laid end to end, classified by code point, cut into words or
pre-tokens with array operations, and the pieces are looked up by a 128-bit
fingerprint, so that costly work is done once per distinct piece.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the memory of a task whatever the batch holds.
SLICE_BYTES = 1 << 20

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_U = np.uint64


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other, by Python's Unicode tables."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


@functools.lru_cache(1)
def library_classes() -> np.ndarray:
    """The same classes as the pattern engine of the tokenizers library has them, whatever Unicode version it knows.

    Each class is asked for once a process: the engine takes its characters out of a text that holds every code point.
    """
    from tokenizers import Regex, normalizers

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        rest = normalizers.Replace(Regex(pattern), "").normalize_str(every)
        inside = np.ones(0x110000, bool)
        inside[np.frombuffer(rest.encode("utf-32-le"), np.uint32)] = False
        table[points[inside[points]]] = kind
    return table


def slices(sizes: Sequence[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``limit``; a longer row stands alone."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def text_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for the slices of an Arrow string column; null counts as empty."""
    texts = [t or "" for t in column.to_pylist()]
    for lo, hi in slices([len(t) for t in texts], limit):
        yield lo, texts[lo:hi]


class Flat:
    """Texts laid end to end.

    ``points`` has all code points, ``ends`` the end of each text in code
    points, ``at`` the byte offset of each code point (one more at the end),
    ``data`` the UTF-8 bytes with padding.
    """

    def __init__(self, texts: Sequence[str]):
        joined = "".join(texts)
        self.points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        raw = joined.encode()
        self.data = np.zeros(len(raw) + 16, np.uint8)
        self.data[: len(raw)] = np.frombuffer(raw, np.uint8)
        if len(raw) == len(self.points):
            self.at = np.arange(len(raw) + 1)
        else:
            p = self.points
            self.at = np.zeros(len(p) + 1, np.int64)
            np.cumsum(1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000).astype(np.int8), out=self.at[1:])

    def first(self) -> np.ndarray:
        """Flags of code points that begin a text."""
        out = np.zeros(len(self.points) + 1, bool)
        out[0] = True
        out[self.ends] = True
        return out[:-1]

    def rows(self, starts: np.ndarray) -> np.ndarray:
        """For each text, the index of its first piece; one more at the end."""
        return np.concatenate(([0], np.searchsorted(starts, self.ends, "left")))

    def keys(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return fingerprints(self.data, self.at[starts], self.at[ends] - self.at[starts])

    def piece(self, start: int, end: int) -> bytes:
        return self.data[self.at[start] : self.at[end]].tobytes()


def fingerprints(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of byte ranges of ``data`` (8 bytes of padding), 8 bytes a round."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = lengths.astype(np.uint64)
    h1, h2 = n * _U(0x9E3779B97F4A7C15) + _U(1), n * _U(0xC2B2AE3D27D4EB4F) + _U(7)

    def mix(h1, h2, v):
        h1 = (h1 ^ v) * _U(0xFF51AFD7ED558CCD)
        h1 ^= h1 >> _U(32)
        h2 = (h2 + v) * _U(0xC4CEB9FE1A85EC53)
        h2 ^= h2 >> _U(29)
        return h1, h2

    h1, h2 = mix(h1, h2, words[starts] & _MASKS[np.minimum(lengths, 8)])
    rest, done = np.flatnonzero(lengths > 8), 8
    while len(rest):
        left = lengths[rest] - done
        h1[rest], h2[rest] = mix(h1[rest], h2[rest], words[starts[rest] + done] & _MASKS[np.minimum(left, 8)])
        done += 8
        rest = rest[left > 8]
    h1 *= _U(0xBF58476D1CE4E5B9)
    h1 ^= h1 >> _U(31)
    h2 *= _U(0x94D049BB133111EB)
    return h1, h2 ^ (h2 >> _U(30))


def plain_words(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of characters other than space and U+0009 to U+000D."""
    p = flat.points
    gap = (p == 0x20) | ((p >= 0x09) & (p <= 0x0D))
    first = flat.first()
    inside = ~gap
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first))
    after = np.concatenate((inside[1:], [False])) & ~np.concatenate((first[1:], [True]))
    return starts, np.flatnonzero(inside & ~after) + 1


def _contractions(points: np.ndarray, kind: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
    """Where a piece begins with an apostrophe and goes on as 's 't 'm 'd 're 've 'll, end it there."""
    n = len(points)
    i = np.flatnonzero((points == 0x27) & start)
    for tail in ("s", "t", "m", "d", "re", "ve", "ll"):
        j = i[i + len(tail) < n]
        for k, letter in enumerate(tail, 1):
            j = j[(points[j + k] == ord(letter)) & ~first[j + k]]
        start[j + 1] = False
        j = j[j + len(tail) + 1 < n] + len(tail) + 1
        start[j[kind[j] == LETTER]] = True


def spaced_pieces(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the usual byte-level pattern, in which a space joins the run that follows it."""
    points, first = flat.points, flat.first()
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = library_classes()[points]
    start = first | np.concatenate(([True], kind[1:] != kind[:-1]))
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    _contractions(points, kind, start, first)
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def bare_pieces(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the pattern that drops white space: runs of letters, single numbers, runs of others."""
    points, first = flat.points, flat.first()
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = library_classes()[points]
    start = (first | np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == NUMBER)) & (kind != SPACE)
    _contractions(points, kind, start, first)
    cut = np.flatnonzero(start | (kind == SPACE) | first)
    ends = np.append(cut[1:], n)
    keep = start[cut]
    return cut[keep], ends[keep]


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges (offset, length), end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(offsets - before, lengths) + np.arange(total)


def give_back() -> None:
    """Return memory that is no longer used to the system: a Python worker lives on for other tasks and holds it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the C library that has it
        trim(0)


class PieceCache:
    """Token ids of pieces by fingerprint: a bounded two-way table over a growing pool.

    ``encode(list of (data, starts, lengths))`` is called for missing pieces
    only. When the pool is full, it starts anew; results never depend on it.
    """

    def __init__(self, encode, bits: int = 20, most: int = 900_000):
        self.encode, self.bits, self.most = encode, bits, most
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.k1, self.k2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.value = np.full(size, -1, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.offset, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _slots(self, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        down = _U(64 - self.bits)
        return (h1 >> down).astype(np.int64), ((h1 * _U(0xD6E8FEB86659FD93)) >> down).astype(np.int64)

    def find(self, flat: Flat, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The pool entry of each piece."""
        h1, h2 = flat.keys(starts, ends)
        if self.n > self.most:
            self.clear()
        a, b = self._slots(h1)
        out = np.where((self.k1[a] == h1) & (self.k2[a] == h2), self.value[a], -1)
        miss = np.flatnonzero(out < 0)
        at = b[miss]
        out[miss] = np.where((self.k1[at] == h1[miss]) & (self.k2[at] == h2[miss]), self.value[at], -1)
        miss = miss[out[miss] < 0]
        if len(miss):
            pairs = np.empty(len(miss), [("a", np.uint64), ("b", np.uint64)])
            pairs["a"], pairs["b"] = h1[miss], h2[miss]
            order = np.lexsort((pairs["b"], pairs["a"]))
            ranked = pairs[order]
            new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
            one = miss[order[new]]
            ids, counts = self.encode(flat.data, flat.at[starts[one]], flat.at[ends[one]] - flat.at[starts[one]])
            base = self._add(ids, counts)
            group = np.empty(len(miss), np.int64)
            group[order] = np.cumsum(new) - 1
            out[miss] = base + group
            spot = np.where(self.value[a[one]] < 0, a[one], b[one])
            self.k1[spot], self.k2[spot], self.value[spot] = h1[one], h2[one], base + np.arange(len(one))
            # Two pieces may have taken one slot: the key that stands there last is whole, as the arrays are written in one order.
        return out

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> int:
        base = self.n
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while base + len(counts) > len(self.offset):
            self.offset, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.offset, self.length))
        self.pool[self.used : self.used + len(ids)] = ids
        self.offset[base : base + len(counts)] = self.used + np.cumsum(counts) - counts
        self.length[base : base + len(counts)] = counts
        self.used += len(ids)
        self.n += len(counts)
        return base

    def ids(self, entries: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.offset[entries], self.length[entries].astype(np.int64))]
