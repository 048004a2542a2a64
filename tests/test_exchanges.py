"""What a panel's columns exchange (findings F2 and F3 of round 4)."""

import pandas as pd

from quillon.functions import cross_section as cs
from quillon.functions import time_series as ts
from quillon.plans.layers import DATE, NAME, SparkPanel


def _table(spark):
    rows = [(f"2020-01-{1 + k % 9:02d}", k // 9, float(k * 7 % 5) if k % 4 else None, float(k * 11 % 17), k % 6 > 0) for k in range(180)]
    return spark.createDataFrame(rows, f"{DATE} string, {NAME} int, x double, y double, tradeable boolean").selectExpr(f"CAST({DATE} AS timestamp) AS {DATE}", NAME, "x", "y", "tradeable")


def _exchanged(plan):
    """Columns of every explicit exchange of a plan."""
    out = [[a.name() for a in _list(plan.output())]] if plan.nodeName() == "RepartitionByExpression" else []
    return out + [n for c in _list(plan.children()) for n in _exchanged(c)]


def _list(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_ranks_of_ranks_are_one_exchange(spark):
    """rows that lay by date already were dealt out by date again after every rank."""
    p = SparkPanel(_table(spark), parts=7)
    first = cs.rank_pct(p, "x")
    again = cs.average_rank(p, p.let(f"{first} * y"))
    third = cs.average_rank(p, p.let(f"{again} - {first}"))
    out = p.frame([first, again, third])
    assert len(_exchanged(out._jdf.queryExecution().optimizedPlan())) == 1
    got, pdf = out.orderBy(DATE, NAME).toPandas(), _table(spark).orderBy(DATE, NAME).toPandas()
    by = pdf[DATE]
    a = pdf.x.groupby(by).rank(pct=True)
    b = (a * pdf.y).groupby(by).rank()
    for name, want in ((first, a), (again, b), (third, (b - a).groupby(by).rank())):
        pd.testing.assert_series_equal(got[name], want, check_names=False)


def test_columns_made_of_one_are_made_after_the_exchange(spark):
    """what is ranked, whether it is known and the value itself were three columns of an exchange."""
    p = SparkPanel(_table(spark), decimals=9, parts=7)
    means = [ts.ts_mean(p, "x", w, 1) for w in (2, 3, 4)]
    ranks = [cs.average_rank(p, m) for m in means]
    out = p.frame([*means, *ranks], [])
    widths = [len(c) for c in _exchanged(out._jdf.queryExecution().optimizedPlan())]
    assert widths == [5]  # keys and three means
    got, pdf = out.orderBy(DATE, NAME).toPandas(), _table(spark).orderBy(NAME, DATE).toPandas()
    for w, r in zip((2, 3, 4), ranks, strict=True):
        pdf["m"] = pdf.groupby(NAME).x.transform(lambda v, w=w: v.rolling(w, min_periods=1).mean()).where(pdf.x.notna())
        want = pdf.m.round(9).groupby(pdf[DATE]).rank()
        pd.testing.assert_series_equal(got[r], want.loc[pdf.sort_values([DATE, NAME]).index].reset_index(drop=True), check_names=False)


def test_windows_after_ranks(spark):
    """Windows over dates of ranks, ranks of these, and contracts in between, together."""
    p = SparkPanel(_table(spark), parts=3)
    r = cs.rank_pct(p, "x")
    d = cs.demean(p, r)
    m = ts.ts_mean(p, d, 2, 1)
    last, other = cs.average_rank(p, m), cs.average_rank(p, p.let(f"{r} + y"))
    got, pdf = p.frame([d, last, other], []).orderBy(DATE, NAME).toPandas(), _table(spark).orderBy(NAME, DATE).toPandas()
    pdf["r"] = pdf.x.groupby(pdf[DATE]).rank(pct=True)
    pdf["d"] = pdf.r - pdf.r.groupby(pdf[DATE]).transform("mean")
    pdf["m"] = pdf.groupby(NAME).d.transform(lambda v: v.rolling(2, min_periods=1).mean()).where(pdf.d.notna())
    pdf["last"], pdf["other"] = pdf.m.groupby(pdf[DATE]).rank(), (pdf.r + pdf.y).groupby(pdf[DATE]).rank()
    pdf = pdf.sort_values([DATE, NAME]).reset_index(drop=True)
    pd.testing.assert_series_equal(got[d], pdf.d, check_names=False)
    pd.testing.assert_series_equal(got[other], pdf.other, check_names=False)
    assert (got[last] - pdf["last"]).abs().max() < 3 and got[last].notna().equals(pdf["last"].notna())  # ties in the last bits


def test_dates_that_are_not_wanted_are_not_exchanged(spark):
    """every date went through the exchanges, and those that aren't wanted were left out at the end."""
    late = f"{DATE} >= TIMESTAMP '2020-01-06'"
    p = SparkPanel(_table(spark), parts=2)
    m = ts.ts_mean(p, "y", 5)
    cols = [m, cs.average_rank(p, m)]
    got, want = p.frame(cols, [], late), p.frame(cols, []).where(late)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") < plan.rindex("2020-01-06") < plan.index("Window")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 80
    some = p.frame(cols, ["tradeable"], "tradeable").drop("tradeable")  # not whole dates: ranks are among all rows
    assert sorted(map(tuple, some.collect()), key=str) == sorted(map(tuple, p.frame(cols, ["tradeable"]).where("tradeable").drop("tradeable").collect()), key=str)
    assert p.frame(cols, [], "tradeable").count() == 150
