"""Residuals by columns against least squares of each date."""

import datetime as dt

import numpy as np
import pytest

from quillon.operators import regression
from quillon.plans.layers import DATE, NAME


def dates():
    """Control values by date: full rank, one the sum of others, one constant, all the same, few rows."""
    r = np.random.default_rng(0)
    full = r.normal(size=(40, 3)) * [1, 100, 0.01] + [0, 5000, 0]
    collinear = full.copy()
    collinear[:, 2] = collinear[:, 0] * 2 - collinear[:, 1]
    constant = full.copy()
    constant[:, 1] = 7
    return {"full": full, "collinear": collinear, "constant": constant, "same": np.ones((20, 3)), "few": full[:4], "enough": full[:5]}


def frame(spark):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for k, (name, x) in enumerate(dates().items()):
        y = r.normal(size=len(x)) + x[:, 0]
        for i in range(len(x)):
            rows.append((dt.datetime(2024, 1, 1 + k), f"c{i}", float(y[i]), *map(float, x[i])))
        rows.append((dt.datetime(2024, 1, 1 + k), "none", None, 1.0, 1.0, 1.0))
        rows.append((dt.datetime(2024, 1, 1 + k), "gap", 9.0, None, 1.0, 1.0))
        want[1 + k] = name, x, y
    return spark.createDataFrame(rows, f"{DATE} timestamp, {NAME} string, y double, a double, b double, c double"), want


@pytest.mark.parametrize("ridge", [0.0, 1e-6, 0.5])
def test_residuals_against_least_squares(spark, ridge):
    df, want = frame(spark)
    got = regression.residuals(df, "y", ["a", "b", "c"], ridge, "r")
    assert got.columns == [*df.columns, "r"]
    by: dict = {}
    for row in got.collect():
        by.setdefault(row[DATE].day, {})[row[NAME]] = row["r"]
    for day, (name, x, y) in want.items():
        own = by[day]
        assert own["none"] is None and own["gap"] is None and len(own) == len(y) + 2
        if len(y) < 5:
            assert all(v is None for v in own.values()), name
            continue
        c = x - x.mean(0)
        c = np.concatenate([c, np.eye(3) * np.sqrt(ridge)])
        t = np.concatenate([y - y.mean(), np.zeros(3)])
        left = (t - c @ np.linalg.lstsq(c, t, rcond=1e-9)[0])[: len(y)]
        assert np.allclose([own[f"c{i}"] for i in range(len(y))], left, atol=1e-6), name


def test_plan_reads_the_table_once(spark):
    df, _ = frame(spark)
    plan = regression.residuals(df, "y", ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") <= 1 and plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Pandas" not in plan


def test_without_controls_and_with_clashing_names(spark):
    df, _ = frame(spark)
    clash = df.withColumnRenamed("c", "_rg0_n")
    got = regression.residuals(clash, "y", [], into="y").where(f"day({DATE}) = 5 AND {NAME} <> 'none'").toPandas()
    assert got.columns.tolist() == [DATE, NAME, "a", "b", "_rg0_n", "y"] and abs(got["y"].sum()) < 1e-9 and got["y"].notna().all()
