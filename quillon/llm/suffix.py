"""Suffix arrays in numpy: Larsson-Sadakane refinement, and Kasai's common prefixes computed in parallel strips."""

from __future__ import annotations

import numpy as np

#: Never occurs in UTF-8; stands between the strings of one array.
SEPARATOR = 0xFF


def _words(text: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from every position on, first byte lowest; ``pad`` beyond the end."""
    t = np.concatenate([text, np.full(8, pad, np.uint8)])
    return np.lib.stride_tricks.as_strided(t, (len(text), 8), (1, 1)).copy().view("<u8").ravel()


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of ``text`` in order of their suffixes, rank of every position), compared to at least ``depth`` bytes.

    Suffixes that are equal so far are in order of position and share their rank.

    Suffixes are first grouped by their leading seven bytes. A suffix's rank is the place of its group's first member, so
    the rank h bytes further on sorts each group to twice the depth; groups of one are done and left alone.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = _words(text, 0).byteswap() >> np.uint64(8)
    sa = np.argsort(key, kind="stable")
    first = np.append(True, key[sa[1:]] != key[sa[:-1]])
    rank = np.zeros(n + 1, np.int64)
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[sa] = head + 1
    bits = np.uint64(max(1, int(n + 1).bit_length()))
    packed = 3 * int(bits) <= 64
    h, at = 7, np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(at) and h < depth:
        pos = sa[at]
        group = rank[pos]
        after = rank[np.minimum(pos + h, n)]
        if packed:
            x = (((group.astype(np.uint64) << bits) | after.astype(np.uint64)) << bits) | pos.astype(np.uint64)
            x.sort()
            pos = (x & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            x >>= bits
            new = np.append(True, x[1:] != x[:-1])
        else:
            order = np.lexsort((pos, after, group))
            pos, group, after = pos[order], group[order], after[order]
            new = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        sa[at] = pos
        rank[pos] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        at = at[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, rank[:n]


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int, strips: int = 1024) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of each suffix in ``sa`` with the one before it (0 for the first).

    Kasai: going through the text, the prefix common with the neighbour in ``sa`` shrinks by at most one from one
    position to the next, so comparing starts where the last one ended. Strips of the text advance side by side. Suffixes
    of one rank have ``most`` bytes in common; as their order is not that of whole suffixes, comparing starts anew after
    them.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    words = np.concatenate([_words(text, 0), np.zeros(most + 8, np.uint64)])
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    tied = np.zeros(n, bool)
    tied[sa[1:]] = rank[sa[1:]] == rank[sa[:-1]]
    step = -(-n // min(strips, n))
    start = np.arange(0, n, step)
    h = np.zeros(len(start), np.int64)
    was = np.zeros(len(start), bool)
    for t in range(step):
        i = start + t
        if i[-1] >= n:
            start, h, was, i = start[:-1], h[:-1], was[:-1], i[:-1]
        j = before[i]
        h = np.where((j >= 0) & ~was, np.maximum(h - 1, 0), 0)
        was = tied[i]
        h[was] = most
        live = np.flatnonzero((j >= 0) & ~was)
        while len(live):
            x = words[i[live] + h[live]] ^ words[j[live] + h[live]]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) // 8).astype(np.int64))
            h[live] = np.minimum(h[live] + same, most)
            live = live[(same == 8) & (h[live] < most)]
        # The zeros beyond the end are not part of the text.
        h = np.where((j >= 0) & ~was, np.minimum(h, n - np.maximum(i, j)), h)
        out[place[i]] = h
    return out
