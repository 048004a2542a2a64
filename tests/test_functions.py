"""Column functions against literal values and numpy."""

import datetime as dt

import numpy as np
import pytest

from quillon.functions import cross_section as cs
from quillon.functions import masks
from quillon.functions import pointwise as pw
from quillon.functions import time_series as ts
from quillon.plans.layers import DATE, NAME, SparkPanel


def panel(spark, **rows):
    """Columns given as date x contract matrices."""
    first = next(iter(rows.values()))
    data = [(dt.datetime(2024, 1, 1 + i, 15), f"C{j}", *(None if m[i][j] is None else float(m[i][j]) for m in rows.values())) for i in range(len(first)) for j in range(len(first[0]))]
    return SparkPanel(spark.createDataFrame(data, f"{DATE} timestamp, {NAME} string, " + ", ".join(f"{k} double" for k in rows)))


def values(p, column, width):
    got = [r[0] for r in p.frame([column]).orderBy(DATE, NAME).select(column).collect()]
    return [got[i : i + width] for i in range(0, len(got), width)]


def close(a, b):
    return all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-6)) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_ranks_with_ties_and_missing(spark):
    p = panel(spark, x=[[1, 2, 2, None, 5]])
    assert close(values(p, cs.rank_pct(p, "x"), 5), [[0.25, 0.625, 0.625, None, 1.0]])


def test_winsorize(spark):
    p = panel(spark, x=[[0, 1, 2, 3, 100], [1, 2, None, None, None]])
    assert close(values(p, cs.winsorize(p, "x"), 5), [[0.2, 1, 2, 3, 80.6], [None] * 5])


def test_zscore_without_spread(spark):
    p = panel(spark, x=[[2, 2, 2], [1, None, 3]])
    assert close(values(p, cs.zscore(p, "x"), 3), [[None] * 3, [-0.70710677, None, 0.70710677]])
    assert values(p, cs.zscore(p, "x", flat="zero"), 3)[0] == [0.0] * 3


def test_residual_is_orthogonal_and_guards(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(3, 9)), rng.normal(size=(3, 9))
    x[2] = 1
    p = panel(spark, x=x.tolist(), y=y.tolist())
    r = values(p, cs.residual(p, "y", "x"), 9)
    for k in (0, 1):
        assert np.dot(r[k], x[k]) == pytest.approx(0, abs=1e-9) and sum(r[k]) == pytest.approx(0, abs=1e-9)
    assert r[2] == [None] * 9
    assert close([values(p, cs.residual(p, "y", "x", flat="demean"), 9)[2]], [(y[2] - y[2].mean()).tolist()])


def test_windows_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=(12, 2))
    m = [[None if (i, j) == (6, 1) else v for j, v in enumerate(r)] for i, r in enumerate(x.tolist())]
    p = panel(spark, x=m)
    mean, decay, med = (values(p, f(p, "x", 5), 2) for f in (ts.ts_mean, ts.decay_linear, ts.ts_median))
    for i in range(12):
        w = x[max(0, i - 4) : i + 1, 0]
        want = (None, None, None) if i < 4 else (w.mean(), np.average(w, weights=np.arange(1, 6)), np.median(w))
        assert close([[mean[i][0], decay[i][0], med[i][0]]], [list(want)])
    assert [r[1] is None for r in mean] == [i < 4 or 6 <= i < 11 for i in range(12)]


def test_selected_means(spark):
    x, y = np.random.default_rng(2).normal(size=(2, 8, 1))
    p = panel(spark, x=x.tolist(), y=y.tolist())
    got = values(p, ts.rolling_selmean_diff(p, "x", "y", 5, 2), 1)
    for i in range(8):
        if i < 4:
            assert got[i][0] is None
        else:
            o = np.argsort(y[i - 4 : i + 1, 0])
            w = x[i - 4 : i + 1, 0]
            assert got[i][0] == pytest.approx(w[o[-2:]].mean() - w[o[:2]].mean())


def test_divisions_and_signs(spark):
    p = panel(spark, x=[[1, -2, 3]], y=[[0, 1e-7, 2]])
    assert values(p, pw.divide(p, "x", "y"), 3) == [[None, None, 1.5]]
    assert close(values(p, pw.slog(p, "x"), 3), [[np.log(2), -np.log(3), np.log(4)]])


def test_gates(spark):
    p = panel(spark, x=[[1, None, 3]], c=[[1, 1, 0]])
    assert values(p, masks.gate_nan(p, "x", "c"), 3) == [[1.0, None, None]]
    assert values(p, masks.gate_zero(p, "x", "c"), 3) == [[1.0, None, 0.0]]


def test_no_look_ahead(spark):
    x = np.random.default_rng(3).normal(size=(10, 3)).tolist()
    whole, cut = panel(spark, x=x), panel(spark, x=x[:7])
    for f in (lambda p: ts.ts_meanrank(p, "x", 5), lambda p: ts.ts_zscore(p, "x", 5)):
        assert close(values(whole, f(whole), 3)[:7], values(cut, f(cut), 3))


def test_equal_expressions_are_one_column(spark):
    p = panel(spark, x=[[1, 2]])
    assert cs.zscore(p, "x") == cs.zscore(p, "x")
    n = len(p.sql)
    cs.zscore(p, "x")
    assert len(p.sql) == n
