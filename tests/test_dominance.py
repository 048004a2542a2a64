"""Fronts ranked in cells, against the ranking of one list."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import dominance, selection


def frame(spark, m):
    names = [f"f{k}" for k in range(m.shape[1])]
    rows = [(i, *[None if v != v else float(v) for v in x]) for i, x in enumerate(m)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)), names


def shapes():
    r = np.random.default_rng(0)
    yield "cloud", r.normal(size=(300, 2))
    yield "rising", np.sort(r.normal(size=(200, 2)), axis=0)  # every candidate dominates those before
    yield "falling", np.stack([np.arange(200.0), -np.arange(200.0)], 1)  # one front
    yield "ties", r.integers(0, 6, (300, 2)).astype(float)
    yield "missing", np.where(r.random((200, 2)) < 0.2, np.nan, r.integers(0, 9, (200, 2)))
    yield "infinite", np.where(r.random((150, 2)) < 0.2, np.inf, r.normal(size=(150, 2)))
    yield "one", r.integers(0, 40, (150, 1)).astype(float)
    yield "three", r.normal(size=(250, 3))
    yield "three with ties", r.integers(0, 5, (250, 3)).astype(float)
    yield "four", r.integers(0, 4, (150, 4)).astype(float)


@pytest.mark.parametrize("name, m", list(shapes()), ids=[n for n, _ in shapes()])
def test_fronts_against_one_list(spark, name, m):
    df, names = frame(spark, m)
    want = {i: f for f, members in enumerate(selection.fronts(m)) for i in members}
    rows = 40 if m.shape[1] <= 2 else 70
    got = {r.id: r.front for r in dominance.with_fronts(df, names, cell_rows=rows).collect()}
    assert got == want
    assert dominance.with_fronts(df, names).columns == ["id", *names, "front"]


def test_elites_against_one_list(spark):
    r = np.random.default_rng(1)
    m = np.round(r.normal(size=(120, 2)), 1)
    df, names = frame(spark, m)
    df = df.withColumn("cost", F.col("id") % 7)
    for n, cost in ((0, None), (17, None), (17, "cost"), (120, None), (500, "cost")):
        got = {x.id for x in dominance.elites(df, names, n, "id", cost).collect()}
        assert got == set(selection.elites(m, n, [i % 7 for i in range(120)] if cost else None))


def test_empty_and_single(spark):
    df, names = frame(spark, np.zeros((3, 2)))
    assert dominance.with_fronts(df.limit(0), names).count() == 0
    assert [r.front for r in dominance.with_fronts(df, names).collect()] == [0, 0, 0]


def test_profiles_lose_nothing():
    r = np.random.default_rng(2)
    for width in (1, 2):
        p, f, q = r.integers(0, 9, (80, width)).astype(float), r.integers(0, 6, 80), r.integers(0, 9, (60, width)).astype(float)
        keep = dominance.profile(p, f)
        want = [max((int(b) for a, b in zip(p, f, strict=True) if (a >= x).all()), default=-1) for x in q]
        assert dominance.reached(p[keep], f[keep], q).tolist() == want and len(keep) < len(p)
