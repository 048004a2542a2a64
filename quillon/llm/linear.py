"""Hashed word n-grams and logistic regression by follow-the-regularised-leader updates (FTRL-proximal)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quillon.llm import text as T

_REPEAT = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Features:
    """Word unigrams and bigrams, hashed to ``2 ** bits`` places.

    ``stems``: the first so many bytes of longer words count as well, for inflected forms.
    ``marks`` makes runs of punctuation tokens as well. A bigram of a word with itself falls in one shared place, so that
    repetition is seen whichever word repeats. ``norm``: a place counts log(1 + occurrences), and a text's vector has
    length 1; otherwise a place counts 1 where it occurs at all.
    """

    bits: int = 20
    marks: bool = True
    norm: bool = True
    stems: tuple[int, ...] = ()

    def of(self, b: np.ndarray, o: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, value), each (text, place) once, by text. ``wanted``: places that matter, where no norm needs the others."""
        s, e, bounds = T.tokens(b, o, T.classes("marks" if self.marks else "alnum"))
        sums = T.Prefixes(b)
        h = sums.hash(s, e)
        doc = T.owners(bounds)
        two = np.zeros(0, np.uint64)
        if len(h) > 1:
            same = doc[1:] == doc[:-1]
            two = T.mix(h[:-1] * np.uint64(3) + h[1:])
            two = np.where(h[:-1] == h[1:], _REPEAT, two)[same]
            doc2 = doc[1:][same]
            doc = np.concatenate([doc, doc2])
        every = [h, two]
        for k in self.stems:
            at = np.flatnonzero(e - s > k)
            every.append(sums.hash(s[at], s[at] + k) ^ np.uint64(k << 50))
            doc = np.concatenate([doc, T.owners(bounds)[at]])
        place = np.concatenate(every) >> np.uint64(64 - self.bits)
        if wanted is not None and not self.norm:
            keep = wanted[place.astype(np.int64)]
            place, doc = place[keep], doc[keep]
        key = np.sort((doc.astype(np.uint64) << np.uint64(self.bits)) | place)
        if len(key) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(first, len(key)))
        key = key[first]
        doc, place = (key >> np.uint64(self.bits)).astype(np.int64), (key & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        if not self.norm:
            return doc, place, np.ones(len(doc))
        v = np.log1p(n)
        return doc, place, v / np.sqrt(np.bincount(doc, v * v, len(o) - 1))[doc]


@dataclass(frozen=True)
class Model:
    """Weights of a fitted classifier; ``bias`` is the log-odds of an empty text."""

    features: Features
    weights: np.ndarray
    bias: float

    def scores(self, b: np.ndarray, o: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each text: a sparse dot product."""
        out = np.full(len(o) - 1, self.bias)
        for i, j, bb, oo in T.blocks(b, o):
            doc, place, v = self.features.of(bb, oo, self.weights != 0 if not self.features.norm else None)
            out[i:j] += np.bincount(doc, self.weights[place] * v, j - i)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2; coordinate 0 of ``bias`` is not regularised by L1."""

    def __init__(self, size: int, alpha: float, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, self.l1) if not isinstance(at, slice) else np.append(np.full(len(self.z) - 1, self.l1), 0.0)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def push(self, at: np.ndarray, g: np.ndarray) -> None:
        w, n = self.weights(at), self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def learn(self, at: np.ndarray, v: np.ndarray, y: float) -> None:
        m = np.clip(self.weights(at) @ v, -40, 40)
        self.push(at, (1 / (1 + np.exp(-m)) - y) * v)


def fit(features: Features, rows: list[tuple[int, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, float]]]], *, alpha: float, l1: float, l2: float, epochs: int, swap_weight: float = 0.0, seed: int = 13) -> Model:
    """Fit on (label, places, values, counterfactuals as (places, values that differ, weight)).

    Each counterfactual of a text adds ``swap_weight * weight / 2 * (score - counterfactual score) ** 2`` in log-odds to
    the loss, so that places which only tell the texts apart lose their weight. Without rows, or with one label only, the
    model is its bias.
    """
    size = 1 << features.bits
    ones = sum(r[0] for r in rows)
    if not rows or ones in (0, len(rows)):
        p = 0.5 if not rows else (ones + 1) / (len(rows) + 2)
        return Model(features, np.zeros(size), float(np.log(p / (1 - p))))
    f = Ftrl(size, alpha, l1=l1, l2=l2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, at, v, others = rows[i]
            f.learn(np.append(at, size), np.append(v, 1.0), y)
            for places, d, weight in others if swap_weight else ():
                if len(places):
                    f.push(places, swap_weight * weight * np.clip(f.weights(places) @ d, -4, 4) * d)
    w = f.weights(slice(None))
    return Model(features, w[:-1].astype(np.float32), float(w[-1]))
