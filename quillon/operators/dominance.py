"""Fronts of candidates by several objectives, all to be large, without bringing candidates to the driver.

The front of a candidate is the length of the longest chain of candidates that dominate one another and it. Quantiles cut
each objective into ranges, and so the candidates into cells. Of two cells one is beyond the other in every objective, and
dominates it whole; or they share some ranges, and only those objectives need comparing; or they have nothing to do with
each other. Cells are ranked in waves: those of one wave can't dominate each other, and all that can dominate them were
ranked before. From a ranked cell go its largest front, a number, to the cells it dominates whole, and to those that share
ranges with it a profile: of each front what reaches farthest in the shared objectives.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.selection import crowding_by_front
from quillon.plans.storage import written

#: Distinct candidates a cell should have: with up to two objectives they are placed by bisection, with more each is compared with those before it.
CELL_ROWS, COMPARED_ROWS = 65536, 4096
#: Cells at most, by the rows of each they grow beyond it.
MOST_CELLS = 4096
_BLOCK = 512


def objective(c: str):
    """As a double; what is missing or isn't finite is worst."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(float("-inf"))).otherwise(x)


def reached(profile: np.ndarray, fronts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """For each of ``points`` the largest front in ``profile`` that is at least as large in every column; -1 where none is."""
    out = np.full(len(points), -1)
    if not len(profile):
        return out
    if points.shape[1] == 1:
        order = np.argsort(-profile[:, 0], kind="stable")
        best = np.maximum.accumulate(fronts[order])
        n = np.searchsorted(-profile[order, 0], -points[:, 0], side="right")
        return np.where(n > 0, best[np.maximum(n - 1, 0)], -1)
    for i in range(0, len(points), _BLOCK):
        over = (profile[None] >= points[i : i + _BLOCK, None]).all(2)
        out[i : i + _BLOCK] = np.where(over, fronts[None], -1).max(1)
    return out


def place(points: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Fronts of distinct points, each at least its ``least``."""
    order = np.lexsort(points.T[::-1])[::-1]
    x, least = points[order], least[order]
    got = np.zeros(len(x), np.int64)
    if x.shape[1] <= 2:
        # Steps down in the last objective and up in the front: how far what was placed reaches.
        down: list[float] = []
        up: list[int] = []
        for i, (last, own) in enumerate(zip((-x[:, -1] if x.shape[1] == 2 else np.zeros(len(x))).tolist(), least.tolist(), strict=True)):
            k = bisect.bisect_right(down, last)
            f = max(own, up[k - 1] + 1) if k else own
            got[i] = f
            if k and down[k - 1] == last:
                k -= 1
            end = bisect.bisect_right(up, f, lo=k)
            down[k:end], up[k:end] = [last], [f]
    else:
        for i in range(len(x)):
            over = got[:i][(x[:i] >= x[i]).all(1)]
            got[i] = max(least[i], over.max() + 1) if len(over) else least[i]
    out = np.empty_like(got)
    out[order] = got
    return out


def profile(points: np.ndarray, fronts: np.ndarray) -> np.ndarray:
    """Which of ``points`` (a cell's, in the shared objectives) tell others anything: no other of as high a front reaches as far."""
    order = np.lexsort([*points.T, fronts])[::-1]
    keep: list[int] = []
    if points.shape[1] == 1:
        seen = -math.inf
        for i in order.tolist():
            # Higher fronts come first; of those below, only what reaches farther.
            if points[i, 0] > seen or not keep:
                keep.append(i)
                seen = points[i, 0]
        return np.array(keep, int)
    for i in order.tolist():
        if not keep or not (points[keep] >= points[i]).all(1).any():
            keep.append(i)
    return np.array(keep, int)


def with_fronts(candidates: DataFrame, objectives: Sequence[str], into: str = "front", cell_rows: int | None = None) -> DataFrame:
    """``candidates`` with their front, 0 for those that nothing dominates.

    Equal candidates share a front and are ranked once. Objectives that are missing or not finite count as worst. An empty
    table stays empty. The driver holds one row per cell, MOST_CELLS at most; a task one cell, and the profiles of cells
    that share a range with it.
    """
    spark, m = candidates.sparkSession, len(objectives)
    names = [f"_o{k}" for k in range(m)]
    keyed = candidates.withColumns(dict(zip(names, map(objective, objectives), strict=True)))
    points = written(keyed.select(*names).distinct(), "points")
    n = points.count()
    rows = cell_rows or (CELL_ROWS if m <= 2 else COMPARED_ROWS)
    ranges = max(1, min(math.ceil((n / rows) ** (1 / m)), int(MOST_CELLS ** (1 / m) + 1e-9)))
    cells = [f"_c{k}" for k in range(m)]
    if ranges > 1:
        parts = [i / ranges for i in range(1, ranges)]
        cuts = points.agg(*[F.percentile_approx(o, parts, 10 * ranges).alias(o) for o in names]).first()
        at = [sum((F.col(o) >= F.lit(v)).cast("int") for v in sorted(set(cuts[o]))) for o in names]
    else:
        at = [F.lit(0)] * m
    dealt = points.withColumns(dict(zip(cells, at, strict=True)))
    wave = reduce(lambda a, b: a + b, [F.lit(ranges - 1) - F.col(c) for c in cells])
    dealt = written(dealt.withColumn("_wave", wave.cast("int")), "cells", ["_wave"])
    known = sorted((tuple(r)[0], tuple(tuple(r)[1:])) for r in dealt.select("_wave", *cells).distinct().collect())
    masks = [s for size in range(1, m) for s in combinations(range(m), size)]
    key = F.concat_ws(",", *cells)
    name = lambda cell: ",".join(map(str, cell))
    schema = ", ".join(["_cell string", "_mask int", *[f"{o} double" for o in names], "_front long", "_least long"])

    def rank_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["_mask"].to_numpy() < 0
        x = pdf[names].to_numpy()
        mine, least = x[own], pdf["_least"].to_numpy()[own].astype(np.int64)
        for k, mask in enumerate(masks):
            told = pdf["_mask"].to_numpy() == k
            if told.any():
                least = np.maximum(least, reached(x[told][:, mask], pdf["_front"].to_numpy()[told].astype(np.int64), mine[:, mask]) + 1)
        fronts = place(mine, least)
        cell = pdf["_cell"].iloc[0]
        out = [pd.DataFrame(mine, columns=names).assign(_mask=-1, _front=fronts)]
        for k, mask in enumerate(masks):
            kept = profile(mine[:, mask], fronts)
            out.append(pd.DataFrame(mine[kept], columns=names).assign(_mask=k, _front=fronts[kept]))
        return pd.concat(out).assign(_cell=cell, _least=0)[["_cell", "_mask", *names, "_front", "_least"]]

    highest: dict[tuple, int] = {}
    ranked: list[DataFrame] = []
    for w in sorted({w for w, _ in known}):
        now = [c for v, c in known if v == w]
        least = [(name(c), max((f + 1 for d, f in highest.items() if all(x > y for x, y in zip(d, c, strict=True))), default=0)) for c in now]
        # One row per cell of the wave.
        given = F.broadcast(spark.createDataFrame(least, "_cell string, _least long"))
        whole = dealt.where(F.col("_wave") == w).select(key.alias("_cell"), F.lit(-1).alias("_mask"), *names, F.lit(0).cast("long").alias("_front"))
        whole = whole.join(given, "_cell").select("_cell", "_mask", *names, "_front", "_least")
        shares = lambda d, c, s: all(d[k] == c[k] if k in s else d[k] > c[k] for k in range(m))
        told = [(name(d), k, name(c)) for c in now for d in highest for k, s in enumerate(masks) if shares(d, c, s)]
        if told:
            # At most one row per pair of cells in one line.
            to = F.broadcast(spark.createDataFrame(told, "_cell string, _mask int, _to string"))
            before = reduce(DataFrame.unionByName, ranked).where("_mask >= 0").join(to, ["_cell", "_mask"])
            whole = whole.unionByName(before.select(F.col("_to").alias("_cell"), "_mask", *names, "_front", "_least"))
        done = written(whole.groupBy("_cell").applyInPandas(rank_cell, schema), "ranked")
        ranked.append(done)
        for r in done.where("_mask < 0").groupBy("_cell").agg(F.max("_front").alias("f")).collect():
            highest[tuple(map(int, r["_cell"].split(",")))] = r["f"]
    if not ranked:
        return candidates.withColumn(into, F.lit(None).cast("int"))
    found = reduce(DataFrame.unionByName, ranked).where("_mask < 0").select(*names, F.col("_front").cast("int").alias("_front"))
    return keyed.join(found, names).select(*candidates.columns, F.col("_front").alias(into))


def ranked(candidates: DataFrame, objectives: Sequence[str], key: str, cell_rows: int | None = None) -> DataFrame:
    """``candidates`` with front and crowding, as selection takes them: by front, then the less crowded first."""
    return crowding_by_front(with_fronts(candidates, objectives, "front", cell_rows), "front", [*objectives], key)


def elites(candidates: DataFrame, objectives: Sequence[str], n: int, key: str, cost: str | None = None, cell_rows: int | None = None) -> DataFrame:
    """``n`` candidates: whole fronts, then of the front that doesn't fit the least crowded, or with ``cost`` the simplest first; ties go by ``key``."""
    r = written(ranked(candidates, objectives, key, cell_rows), "elites")
    room, last = n, -1
    for f in r.groupBy("front").count().orderBy("front").limit(n).collect():  # n fronts have n candidates at least
        last = f["front"]
        if f["count"] > room:
            break
        room -= f["count"]
    else:
        return r.where(F.col("front") <= last) if room < n else r.limit(0)
    order = [*([F.col(cost)] if cost else []), F.desc("crowding"), F.col(key)]
    return r.where(F.col("front") < last).unionByName(r.where(F.col("front") == last).orderBy(*order).limit(room))
