"""Vectorised tokenising and hashing of Arrow string columns.

Texts stay in Arrow's UTF-8 buffer. A token is a run of bytes of one class; its 64-bit hash is a polynomial in the bytes,
taken for all tokens at once from one running sum. Bytes above 0x7F count as they stand, so runs of non-ASCII characters
are kept whole and only A-Z are folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))
_K = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def classes(space: str) -> np.ndarray:
    """Byte classes: 0 separates tokens; ``alnum`` drops ASCII marks, ``space`` keeps all but white space, ``marks`` has marks as tokens of their own."""
    t = np.ones(256, np.uint8)
    white = [0x20, *range(0x09, 0x0E)]
    if space == "space":
        t[white] = 0
        return t
    t[:0x30] = 0
    t[0x3A:0x61] = 0
    t[0x7B:0x80] = 0
    t[0x41:0x5B] = 1  # A-Z, folded to a-z
    if space == "marks":
        t[:0x80][t[:0x80] == 0] = 2
        t[white] = 0
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        for i, base in enumerate((_MUL, _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls count as empty."""
    a = pc.fill_null(column, "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    _, offs, data = a.buffers()
    if len(a) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    o = np.frombuffer(offs, kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def blocks(b: np.ndarray, o: np.ndarray, size: int = BLOCK_BYTES, most: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut (bytes, offsets) into runs of whole texts of about ``size`` bytes and at most ``most`` texts: (first, last, bytes, offsets)."""
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + size, "right")) - 1)
        j = min(j, n, i + most)
        yield i, j, b[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j


def tokens(b: np.ndarray, o: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): tokens as byte ranges; those of text i are bounds[i]:bounds[i + 1]."""
    n = len(b)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(o), np.int64)
    c = table[b]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(c[1:], c[:-1], out=first[1:])
    cut = o[:-1][o[:-1] < n]
    first[cut] = True
    edge = np.flatnonzero(first)
    keep = c[edge] != 0
    starts = edge[keep]
    ends = np.append(edge[1:], n)[keep]
    return starts, ends, np.searchsorted(starts, o)


def hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    return Prefixes(b, fold).hash(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def owners(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def runs(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` consecutive tokens inside one text, and where each starts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:n].copy()
    for j in range(1, k):
        g = g * _K + h[j : n + j]
    last = np.repeat(bounds[1:], np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(n) + k <= last)
    return mix(g[at] + np.uint64(k)), at


def folded(hs: np.ndarray) -> np.uint64:
    """The hash ``runs`` gives a window made of exactly these token hashes."""
    g = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in hs:
            g = g * _K + x
        return mix(np.array([g + np.uint64(len(hs))], np.uint64))[0]


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, most alike first: high bytes of sorted or small numbers compress well that way."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


class Prefixes:
    """Running sums over one block of bytes, so that any byte range in it is hashed in one step."""

    def __init__(self, b: np.ndarray, fold: bool = True):
        p, self.inverse = powers(len(b) + 1)
        self.sums = np.empty(len(b) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((_FOLDED if fold else _BYTE)[b] * p[: len(b)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])
