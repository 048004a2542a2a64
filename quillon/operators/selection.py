"""Selection by several objectives, all to be large: dominance, fronts, crowding, elites."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rank:
    index: int
    front: int
    crowding: float


def clean(objectives: Sequence[Sequence[float]]) -> np.ndarray:
    """Objectives as a matrix; what isn't finite is worst."""
    m = np.array(objectives, float)
    m = m.reshape(len(m), -1) if len(m) else m.reshape(0, 1)
    return np.where(np.isfinite(m), m, -np.inf)


def dominates(a: Sequence[float], b: Sequence[float]) -> bool:
    x, y = clean([a, b])
    return bool((x >= y).all() and (x > y).any())


def fronts(objectives: Sequence[Sequence[float]]) -> list[list[int]]:
    """Indices by front: each front is what nothing left dominates.

    Candidates are placed best first, so that only those placed before can dominate one. If none of a front does, none of
    a later front does, and its front is found by bisection; with two objectives a front's largest second one tells. No
    matrix of pairs is held.
    """
    m = clean(objectives)
    out: list[list[int]] = []
    tops: list[float] = []  # of each front, less its largest last objective
    last: list[float] | None = None
    k = 0
    order = np.lexsort(-m.T[::-1]) if len(m) else np.zeros(0, int)
    for i, x in zip(order.tolist(), m[order].tolist(), strict=True):
        if x != last:
            if len(x) <= 2:
                k = bisect.bisect_right(tops, -x[-1])
            else:
                k = bisect.bisect_left(out, True, key=lambda front: not (m[front] >= m[i]).all(1).any())
            last = x
        if k == len(out):
            out.append([])
            tops.append(-x[-1])
        tops[k] = min(tops[k], -x[-1])
        out[k].append(i)
    return [sorted(front) for front in out]


def crowding(objectives: Sequence[Sequence[float]], front: Sequence[int]) -> dict[int, float]:
    """Summed relative distance between each member's neighbours in every objective; ends are infinite."""
    return _crowding(clean(objectives), front)


def _crowding(objectives: np.ndarray, front: Sequence[int]) -> dict[int, float]:
    m = objectives[list(front)]
    d = np.zeros(len(front))
    for k in range(m.shape[1]):
        order = np.argsort(m[:, k], kind="stable")
        width = m[order[-1], k] - m[order[0], k]
        d[order[[0, -1]]] = math.inf
        if np.isfinite(width) and width > 0:
            d[order[1:-1]] += (m[order[2:], k] - m[order[:-2], k]) / width
    return dict(zip(front, d.tolist(), strict=True))


def rank(objectives: Sequence[Sequence[float]]) -> list[Rank]:
    """All candidates by front, then the less crowded first."""
    m, out = clean(objectives), []
    for f, members in enumerate(fronts(m)):
        c = _crowding(m, members)
        out += [Rank(i, f, c[i]) for i in sorted(members, key=lambda i: (-c[i], i))]
    return out


def elites(objectives: Sequence[Sequence[float]], n: int, cost: Sequence[float] | None = None) -> list[int]:
    """n candidates: whole fronts, then of the front that doesn't fit the least crowded, or with ``cost`` the simplest first."""
    out: list[int] = []
    for members in fronts(objectives):
        c = crowding(objectives, members)
        if len(out) + len(members) > n:
            members = sorted(members, key=lambda i: ((cost[i],) if cost is not None else ()) + (-c[i], i))[: n - len(out)]
        out += members
        if len(out) >= n:
            break
    return out


def penalised(objectives: Sequence[Sequence[float]], sizes: Sequence[int], weight: float = 0.001) -> list[list[float]]:
    """Objectives less a charge for size."""
    return [[x - weight * s for x in o] for o, s in zip(objectives, sizes, strict=True)]


def crowding_by_front(candidates: DataFrame, front: str, objectives: Sequence[str], key: str, into: str = "crowding") -> DataFrame:
    """Candidates with the summed relative distance of their neighbours in every objective of their front; ends are infinite, ties go by key. Windows are dealt out by front."""
    total = F.lit(0.0)
    everything = Window.partitionBy(front)
    for o in objectives:
        w = Window.partitionBy(front).orderBy(o, key)
        before, after = F.lag(o).over(w), F.lead(o).over(w)
        width = F.max(o).over(everything) - F.min(o).over(everything)
        part = F.when(width > 0, (after - before) / width).otherwise(0.0)
        total = total + F.when(F.row_number().over(w) == 1, float("inf")).when(F.row_number().over(Window.partitionBy(front).orderBy(F.desc(o), F.desc(key))) == 1, float("inf")).otherwise(part)
    return candidates.withColumn(into, total)
