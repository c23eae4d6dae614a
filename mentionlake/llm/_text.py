"""Vectorised text primitives over Arrow string buffers.

Everything here works on whole texts: a batch is cut between documents, never inside one, into
chunks of about ``CHUNK`` bytes, and each chunk is processed by a fixed number of numpy passes.
Words are maximal runs of bytes outside space and 0x09-0x0D; all of these are ASCII, so byte and
code point views agree on word borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
U64 = np.uint64

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_GRAM_BASE = U64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(CHUNK + 1, n)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 8 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; changes a fresh uint64 array in place where it can."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive whole documents."""
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Word borders of a chunk: ``start``, ``end`` in bytes; ``bounds[d]:bounds[d + 1]`` are document d's words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        n = len(data)
        solid = ~WHITE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        first = solid.copy()
        last = solid.copy()
        if n:
            first[1:] &= ~solid[:-1] | edge[1:n]
            last[:-1] &= ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offs)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.counts)

    def prefix(self) -> np.ndarray:
        """Prefix sums of byte keys times powers: ``span_hash`` of any byte range in constant time."""
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_KEYS[self.data] * _power(_BASE, len(self.data)), out=out[1:])
        return out

    def span_hash(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range's content, wherever it stands."""
        inverse = _power(_BASE_INVERSE, len(self.data) + 1)
        h = (prefix[end] - prefix[start]) * inverse[start]
        return mix(h + (end - start).astype(np.uint64) * U64(0xA24BAED4963EE407))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.prefix(), self.start, self.end)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each window of n word hashes (len - n + 1 of them; document borders are ignored)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:m].copy()
    for j in range(1, n):
        out *= _GRAM_BASE
        out += words[j : m + j]
    return mix(out)


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts (n + 1) of code points: bytes that continue none."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def per_doc(prefix: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over bounds[d]:bounds[d + 1] from prefix sums."""
    return prefix[bounds[1:]] - prefix[bounds[:-1]]


def summed(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=out[1:])
    return out


def eights(data: np.ndarray, extra: int = 8) -> np.ndarray:
    """At each byte position the next 8 bytes as a little-endian number (zeros after the end)."""
    padded = np.zeros(len(data) + extra + 8, dtype=np.uint8)
    padded[: len(data)] = data
    view = np.lib.stride_tricks.as_strided(padded.view(), shape=(len(data) + extra, 8), strides=(1, 1))
    return np.ascontiguousarray(view).view("<u8").reshape(-1)


def compact(words: Words, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words set side by side with one space after each: bytes and each word's new start and end."""
    size = words.end - words.start + 1
    ends = np.cumsum(size)
    start = ends - size
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total) + np.repeat(words.start - start, size)
    data = words.data
    if lower:
        data = ASCII_LOWER[data]
    out = data[np.minimum(source, max(len(data) - 1, 0))] if total else np.zeros(0, np.uint8)
    out[ends - 1] = 32
    return out, start, ends - 1


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range, all ranges at once."""
    at = eights(data, 40)
    length = (end - start).astype(np.int64)
    h = np.full(len(start), _P5 + U64(seed), dtype=np.uint64)
    pos = start.astype(np.int64).copy()
    long = np.flatnonzero(length >= 32)
    if len(long):
        long = long[np.argsort(-length[long], kind="stable")]
        stripes = length[long] // 32
        p = pos[long]
        s = U64(seed)
        with np.errstate(over="ignore"):
            v = [np.full(len(long), x, dtype=np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
        for k in range(int(stripes[0])):
            m = int(np.searchsorted(-stripes, -k, side="left"))
            for j in range(4):
                v[j][:m] = _round(v[j][:m], at[p[:m] + (32 * k + 8 * j)])
        acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        zero = np.zeros(1, dtype=np.uint64)
        for j in range(4):
            acc = (acc ^ _round(zero, v[j])) * _P1 + _P4
        h[long] = acc
        pos[long] += 32 * stripes
    h += length.astype(np.uint64)
    rest = length % 32
    lanes = rest // 8
    zero = np.zeros(1, dtype=np.uint64)
    for k in range(3):
        i = np.flatnonzero(lanes > k)
        if len(i):
            h[i] = _rotl(h[i] ^ _round(zero, at[pos[i] + 8 * k]), 27) * _P1 + _P4
    pos += 8 * lanes
    i = np.flatnonzero(rest & 4)
    if len(i):
        h[i] = _rotl(h[i] ^ ((at[pos[i]] & U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        pos[i] += 4
    for k in range(3):
        i = np.flatnonzero((rest & 3) > k)
        if len(i):
            h[i] = _rotl(h[i] ^ ((at[pos[i] + k] & U64(0xFF)) * _P5), 11) * _P1
    h ^= h >> U64(33)
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    h ^= h >> U64(32)
    return h


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=bool)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
