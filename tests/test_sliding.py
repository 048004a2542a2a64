"""Medians and selections kept from row to row, against windows sorted one by one."""

import datetime as dt

import numpy as np
import pytest

from quillon.functions import sliding
from quillon.functions import time_series as ts
from quillon.plans.layers import DATE, NAME, SparkPanel


def plain_median(x, w):
    return [float(np.median(x[i - w + 1 : i + 1])) if i >= w - 1 and not np.isnan(x[i - w + 1 : i + 1]).any() else None for i in range(len(x))]


def plain_selected(x, y, w, n):
    out = []
    for i in range(len(x)):
        a, b = x[max(0, i - w + 1) : i + 1], y[max(0, i - w + 1) : i + 1]
        if len(a) < w or np.isnan(a).any() or np.isnan(b).any():
            out.append(None)
            continue
        order = np.argsort(b, kind="stable")
        out.append(float(a[order[-n:]].mean() - a[order[:n]].mean()))
    return out


def made(seed=0, gaps=0.01):
    """Contracts of 1 to 400 rows with gaps and ties."""
    r = np.random.default_rng(seed)
    sizes = [1, 3, 7, 150, 400, 90]
    return {f"c{k}": tuple(np.where(r.random(n) < gaps, np.nan, v) for v in (r.normal(size=n), r.integers(0, 9, n).astype(float))) for k, n in enumerate(sizes)}


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (g is None or g == pytest.approx(w, abs=1e-9))


@pytest.mark.parametrize("w", [1, 2, 5, 120])
def test_functions_against_sorted_windows(spark, w):
    data = made()
    rows = [(n, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), None if a != a else float(a), None if b != b else float(b)) for n, (x, y) in data.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, f"{NAME} string, {DATE} timestamp, x double, y double").repartition(7)
    p = SparkPanel(df)
    names = {"m": ts.ts_median(p, "x", w), "s1": ts.rolling_selmean_diff(p, "x", "y", w, 1), "again": ts.ts_mean(p, ts.ts_median(p, "x", w), 2)}
    if w >= 3:
        names["s3"] = ts.rolling_selmean_diff(p, "x", "y", w, 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # contracts go over several batches
        got = p.frame(list(names.values())).orderBy(NAME, DATE).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) and sliding.ROW not in got.columns
    for n, (x, y) in data.items():
        own = got[got[NAME] == n]
        column = lambda c, own=own: [None if v != v else v for v in own[names[c]]]
        same(column("m"), plain_median(x, w))
        same(column("s1"), plain_selected(x, y, w, 1))
        if w >= 3:
            same(column("s3"), plain_selected(x, y, w, 3))


def test_known_values(spark):
    """Values worked out by hand."""
    rows = [("A", dt.datetime(2020, 1, i + 1), x, y) for i, (x, y) in enumerate(zip((10.0, 20.0, 30.0, 40.0, 50.0), (3.0, 1.0, 2.0, 5.0, 4.0), strict=True))]
    p = SparkPanel(spark.createDataFrame(rows, f"{NAME} string, {DATE} timestamp, x double, y double"))
    s, m = ts.rolling_selmean_diff(p, "x", "y", 3, 1), ts.ts_median(p, "y", 3)
    got = p.frame([s, m]).orderBy(DATE).collect()
    assert [r[s] for r in got] == [None, None, -10.0, 20.0, 10.0] and [r[m] for r in got] == [None, None, 2.0, 2.0, 4.0]


def test_rows_out_of_order_are_refused():
    """The walk itself says no; in a plan the window before it brings the order."""
    import pyarrow as pa

    class Frame:  # stands for a table whose rows come numbered 1, 3
        schema = type("S", (), {"add": lambda self, *a: self})()

        def select(self, *a):
            return self

        def mapInArrow(self, run, schema):
            return list(run([pa.RecordBatch.from_pydict({"x": [1.0, 2.0], sliding.ROW: [1, 3]})]))

    with pytest.raises(RuntimeError, match="out of order"):
        sliding.slide(Frame(), {"m": sliding.Slide("median", ("x",), 2)}, "ORDER BY x")


def test_wide_windows_cost_no_more_than_narrow_ones():
    import time

    r = np.random.default_rng(3)
    x, y = r.normal(size=40_000), r.normal(size=40_000)
    took = {}
    for w in (5, 1000):
        best = []
        for _ in range(3):
            a = time.perf_counter()
            sliding.SelectedMeans(w, [1, 3]).feed(np.zeros(1, int), x, y)
            sliding.Medians(w).feed(np.zeros(1, int), x)
            best.append(time.perf_counter() - a)
        took[w] = min(best)
    assert took[1000] < 3 * took[5]
