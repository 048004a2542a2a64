import numpy as np
import pandas as pd

from quillon.functions import cross_section as cs
from quillon.functions import ranking
from quillon.functions import time_series as ts
from quillon.operators import metrics as mt
from quillon.operators import scorer as sc
from quillon.plans.layers import DATE, NAME, SparkPanel


def _table(spark):
    rows = [(f"2020-01-{1 + k % 9:02d}", k // 9, float(k * 7 % 5) if k % 4 else None, float(k * 11 % 17), f"g{k // 9 % 3}" if k % 5 else None) for k in range(180)]
    return spark.createDataFrame(rows, f"{DATE} string, {NAME} int, x double, y double, g string").selectExpr(f"CAST({DATE} AS timestamp) AS {DATE}", NAME, "x", "y", "g")


def _exchanged(plan):
    """Columns of every explicit exchange of a plan."""
    out = [plan.output().size()] if plan.nodeName() == "RepartitionByExpression" else []
    children = plan.children()
    return out + [n for i in range(children.size()) for n in _exchanged(children.apply(i))]


def test_columns_of_a_row_are_not_exchanged(spark):
    """columns made from a row's own ones were carried through every exchange after them."""
    p = SparkPanel(_table(spark), parts=7)
    made = [p.let(f"x * {i} + y", f"m{i}") for i in range(40)]
    sums = [p.let(f"m{i} - m{i + 1}", f"s{i}") for i in range(39)]
    ranks = [cs.rank_pct(p, m) for m in made[:3]]
    out = p.frame([*sums, *ranks, ts.ts_mean(p, "m5", 2, 1), cs.demean(p, ts.ts_mean(p, ranks[0], 2, 1))], [])
    widths = _exchanged(out._jdf.queryExecution().optimizedPlan())
    assert len(widths) == 2 and max(widths) <= 10
    got = out.orderBy(DATE, NAME).toPandas()
    pdf = _table(spark).orderBy(DATE, NAME).toPandas()
    for i in range(39):
        want = (pdf.x * i + pdf.y) - (pdf.x * (i + 1) + pdf.y)
        pd.testing.assert_series_equal(got[f"s{i}"], want, check_names=False)
    for i, r in enumerate(ranks):
        pd.testing.assert_series_equal(got[r], (pdf.x * i + pdf.y).groupby(pdf[DATE]).rank(pct=True), check_names=False)


def test_ranks_of_a_layer_are_one_sort(spark):
    """F7 to F24: a task held a sort of whole rows for every column that is ranked."""
    p = SparkPanel(_table(spark), parts=7)
    ranks = [cs.average_rank(p, p.let(f"x * {i} - y")) for i in range(6)]
    within = cs.rank_pct(p, "y", "g")
    out = p.frame([*ranks, within])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("MapInArrow") == 1
    got, pdf = out.orderBy(DATE, NAME).toPandas(), _table(spark).orderBy(DATE, NAME).toPandas()
    for i, r in enumerate(ranks):
        pd.testing.assert_series_equal(got[r], (pdf.x * i - pdf.y).groupby(pdf[DATE]).rank(), check_names=False)
    pd.testing.assert_series_equal(got[within], pdf.y.groupby([pdf[DATE], pdf.g]).rank(pct=True), check_names=False)


def test_places_are_the_same_sort(spark):
    """a task held a sort of whole rows for every column that gives rows their places."""
    for rules in (sc.ScorerConfig(), sc.ScorerConfig(steps=("size", "industry")), sc.ScorerConfig(mt.PROGRAM, 5, bins=5, own_bins=False)):
        p = SparkPanel(_table(spark).selectExpr("*", "g AS industry", "y AS size", "y > 3 AS tradeable"), parts=7)
        _, cols = sc.bundle_sql(p, "x", "y", rules)
        plan = p.frame(cols)._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number(" not in plan


def test_places(spark):
    """Places are row numbers by value and contract, also with ties, NaN, zeros of both signs and several dates in a batch."""
    odd = [0.0, -0.0, float("nan"), float("inf"), 1.5, float("-inf"), float("nan"), 1.5, None]
    rows = [(f"2020-01-{1 + k % 4:02d}", f"n{k * 7 % 60:03d}", odd[k % 9], k % 5) for k in range(60)]
    df = spark.createDataFrame(rows, f"{DATE} string, {NAME} string, v double, w int").selectExpr(f"CAST({DATE} AS timestamp) AS {DATE}", NAME, "v", "w")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (4, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            p = SparkPanel(df, parts=1)
            ok = p.let("CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END")
            out = {c: (p.placed(c, ok, down), f"row_number() OVER (PARTITION BY {DATE} ORDER BY {ok} DESC, {c}{' DESC' if down else ''}, {NAME})") for c, down in (("v", False), ("w", True))}
            out |= {"d": (p.placed("v", ok, True), f"row_number() OVER (PARTITION BY {DATE} ORDER BY {ok} DESC, v DESC, {NAME})")}
            got = p.frame(keep=["v", "w"])
            assert all(dict(got.dtypes)[a] == "int" for a, _ in out.values())
            both = got.selectExpr(*[f"CASE WHEN {ok} = 1 THEN {sql} END AS want_{k}" for k, (_, sql) in out.items()], *[f"{a} AS got_{k}" for k, (a, _) in out.items()]).toPandas()
            assert len(both) == 60 and both.got_v.notna().sum() == 54
            for k in out:
                pd.testing.assert_series_equal(both[f"got_{k}"], both[f"want_{k}"], check_names=False)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ranks_over_batches(spark):
    """Dates longer and shorter than a batch."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 7, 20, 33):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            p = SparkPanel(_table(spark), parts=2)
            r, g = cs.average_rank(p, "x"), cs.average_rank(p, "x", "g")
            got, pdf = p.frame([r, g]).orderBy(DATE, NAME).toPandas(), _table(spark).orderBy(DATE, NAME).toPandas()
            pd.testing.assert_series_equal(got[r], pdf.x.groupby(pdf[DATE]).rank(), check_names=False)
            pd.testing.assert_series_equal(got[g], pdf.x.groupby([pdf[DATE], pdf.g]).rank(), check_names=False)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ties_of_zeros_and_nan():
    rank, number = ranking.average_ranks(np.array([0.0, np.nan, -0.0, np.inf, np.nan]))
    assert rank.tolist() == [1.5, 4.5, 1.5, 3, 4.5] and set(number) == {5}
    assert [len(a) for a in ranking.average_ranks(np.zeros(0))] == [0, 0]


def test_wanted_columns_of_the_panel_stay(spark):
    p = SparkPanel(_table(spark))
    assert p.frame(["x", cs.average_rank(p, "y")], ["g"]).columns[:4] == [DATE, NAME, "x", "g"]
