from quillon.functions import cross_section as cs
from quillon.functions import time_series as ts
from quillon.plans.layers import DATE, NAME, SparkPanel


def test_dates_dealt_to_parts_and_one_sort_per_rank(spark):
    rows = [(f"2020-01-{1 + k % 9:02d}", k // 9, float(k * 7 % 5) if k % 4 else None, -0.0 if k % 3 else 0.0) for k in range(180)]
    df = spark.createDataFrame(rows, f"{DATE} string, {NAME} int, x double, y double").selectExpr(f"CAST({DATE} AS timestamp) AS {DATE}", NAME, "x", "y")

    def got(parts):
        p = SparkPanel(df, parts=parts)
        m = ts.ts_mean(p, "x", 2, 1)
        cols = {"rx": cs.average_rank(p, "x"), "ry": cs.average_rank(p, "y"), "rm": cs.rank_pct(p, m), "again": cs.rank_pct(p, ts.ts_mean(p, cs.rank_pct(p, "x"), 2, 1))}
        return p.frame(list(cols.values())).select(DATE, NAME, *cols.values())

    plain, dealt = got(None), got(23)
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))
    pdf = df.toPandas()
    want = {(r.Datetime, r.Contract): (a, b) for r, a, b in zip(pdf.itertuples(), pdf.groupby(DATE).x.rank(), pdf.groupby(DATE).y.rank(), strict=True)}
    for r in dealt.collect():
        a, b = want[r[0], r[1]]
        assert (r[2] is None and a != a or r[2] == a) and r[3] == b
    one = SparkPanel(df, parts=23)
    plan = one.frame([cs.average_rank(one, "x")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1 and ", 23), REPARTITION_BY_NUM" in plan
