"""Functions, metrics, portfolios and templates against literal values and pandas, written independently of the plans."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from quillon.functions import cross_section as cs
from quillon.functions import masks
from quillon.functions import pointwise as pw
from quillon.functions import time_series as ts
from quillon.operators import metrics as mt
from quillon.operators import portfolio as pl
from quillon.operators import regression as rg
from quillon.operators.scorer import EMPTY, OBJECTIVES, WORST, Scorer, ScorerConfig
from quillon.plans import templates as tp
from quillon.plans.layers import DATE, NAME, SparkPanel
from quillon.plans.program import Program, call, const, field
from tests.test_functions import close, panel, values

N = None


def many(p, columns, width):
    """Values of several columns of one plan, as date x contract lists."""
    rows = p.frame(list(columns.values())).orderBy(DATE, NAME).collect()
    return {k: [[r[c] for r in rows[i : i + width]] for i in range(0, len(rows), width)] for k, c in columns.items()}


def test_literal_functions(spark):
    p = panel(spark, x=[[1, 2, 2, N, 5], [3, 3, 3, 3, 3], [1, -2, N, 0, 4]], y=[[1, 0, 2, 4, 1], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5]])
    s = math.sqrt(3)
    got = many(p, {"rank": cs.rank_pct(p, "x"), "z": cs.zscore(p, "x"), "slog": pw.slog(p, "x"), "div": pw.divide(p, "x", "y"), "pos": masks.sign_pos(p, "x"), "neg": masks.sign_neg(p, "x"), "high": masks.rank_high(p, "y", 0.8), "half": masks.rank_high(p, "y", 0.5), "low": masks.rank_low(p, "y", 0.2)}, 5)
    assert close(got["rank"][:2], [[0.25, 0.625, 0.625, N, 1.0], [0.6] * 5])
    assert close(got["z"][:2], [[-1.5 / s, -0.5 / s, -0.5 / s, N, 2.5 / s], [N] * 5])
    assert close([got["slog"][2]], [[math.log(2), -math.log(3), N, 0.0, math.log(5)]]) and close([got["div"][0]], [[1, N, 1, N, 5]])
    assert got["pos"][2] == [1, 0, 0, 0, 1] and got["neg"][2] == [0, 1, 0, 0, 0]
    assert (got["high"][1], got["half"][1], got["low"][1]) == ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1], [1, 0, 0, 0, 0])


def test_literal_windows(spark):
    p = panel(spark, x=[[1], [2], [3], [4], [5]], y=[[2], [4], [6], [8], [10]], sx=[[10], [20], [30], [40], [50]], sy=[[3], [1], [2], [5], [4]])
    got = many(p, {
        "delay": ts.delay(p, "x", 2), "mean": ts.ts_mean(p, "x", 3), "median": ts.ts_median(p, "x", 3), "std": ts.ts_std(p, "x", 3), "delta": ts.ts_delta(p, "x", 2), "range": ts.ts_max_to_min(p, "x", 3),
        "sign": ts.diff_sign(p, "x", 3), "corr": ts.ts_corr(p, "x", "y", 3), "sel": ts.rolling_selmean_diff(p, "sx", "sy", 3, 1),
    }, 1)
    want = {"delay": [N, N, 1, 2, 3], "mean": [N, N, 2, 3, 4], "median": [N, N, 2, 3, 4], "std": [N, N, 1, 1, 1], "delta": [N, N, 2, 2, 2], "range": [N, N, 2, 2, 2], "sign": [N, N, 1, 1, 1], "corr": [N, N, 1, 1, 1], "sel": [N, N, -10, 20, 10]}
    assert all(close(got[k], [[v] for v in w]) for k, w in want.items())
    q = panel(spark, x=[[1, 4], [2, 3], [3, 2], [4, 1]])
    assert close(values(q, ts.ts_meanrank(q, "x", 3), 2), [[N, N], [N, N], [2 / 3, 5 / 6], [5 / 6, 2 / 3]])


def test_tiny_values_are_not_ties(spark):
    """Order is that of exact values unless decimals are asked for."""
    p = panel(spark, x=[[3e-13, 1e-13, 2e-13]])
    assert close(values(p, cs.average_rank(p, "x"), 3), [[3, 1, 2]])
    assert values(p, masks.top_k(p, "x", 1), 3) == [[1, 0, 0]]
    q = SparkPanel(p.base, 9)
    assert close(values(q, cs.average_rank(q, "x"), 3), [[2, 2, 2]])


def traded(p):
    from pyspark.sql import functions as F

    return SparkPanel(p.base.withColumn("tradeable", F.lit(True)))


def rows_of(p, made):
    sql, cols = made
    return p.query(sql, cols).orderBy(DATE) if DATE in p.query(sql, cols).columns else p.query(sql, cols)


def test_literal_correlations(spark):
    p = traded(panel(spark, f=[[1, 2, 3, 4], [4, 3, 2, 1], [1, N, 2, 3]], y=[[1, 2, 3, 4]] * 3))
    for made in (mt.daily_ic(p, "f", "y", mt.MetricRules(least=4)), mt.daily_rank_ic(p, "f", "y", mt.MetricRules(least=4)), mt.daily_rank_ic(p, "f", "y", mt.MetricRules(False, 4))):
        assert [r.ic for r in rows_of(p, made).collect()] == pytest.approx([1.0, -1.0])


def test_score_takes_its_direction(spark):
    p = traded(panel(spark, f=[[-1, -2, -3, -4], [-2, -1, -4, -3]], y=[[1, 2, 3, 4], [2, 1, 4, 3]]))
    s = Scorer(p, "y", ScorerConfig(mt.MetricRules(False, 4), 2, bins=4, own_bins=False)).score_factor("f")
    assert (s.direction, s.days) == (-1, 2) and (s.mean_rank_ic, s.win, s.ndcg, s.coverage) == pytest.approx((-1, 1, 1, 1))
    assert s.signed()["mean_rank_ic"] == pytest.approx(1.0) and s.turnover == pytest.approx(0.0)
    assert EMPTY.objectives("structured") == (0.0, 0.0, 0.0) and all(x == -math.inf for x in WORST.objectives("behaviour")) and len(OBJECTIVES) == 4
    with pytest.raises(ValueError, match="ndcg_k"):
        ScorerConfig(ndcg_k=0)
    with pytest.raises(ValueError, match="objectives"):
        s.objectives("none")


@pytest.fixture(scope="module")
def market(spark):
    """40 dates of 15 names with gaps, two industries and a size; the label leans on -f."""
    r = np.random.default_rng(5)
    dates, names = pd.date_range("2024-01-01 15:00", periods=40), [f"n{k:02d}" for k in range(15)]
    rows = []
    for i, d in enumerate(dates):
        for k, n in enumerate(names):
            f, size = r.normal(), r.normal() + k
            rows.append((d.to_pydatetime(), n, "ab"[k % 2] + "x", bool(r.random() < 0.9), None if r.random() < 0.08 else float(f), float(size), None if i > 35 or r.random() < 0.05 else float(-0.5 * f + r.normal())))
    df = spark.createDataFrame(rows, f"{DATE} timestamp, {NAME} string, industry string, tradeable boolean, f double, size double, label double").cache()
    return SparkPanel(df), df.toPandas()


def wide(df, c):
    return df.pivot(index=DATE, columns=NAME, values=c).astype(float)


def daily(a, b, ranked, least, joint=True):
    out = []
    for d in a.index:
        x, y = a.loc[d], b.loc[d]
        if ranked and not joint:
            x, y = x.rank(), y.rank()
        ok = x.notna() & y.notna()
        x, y = x[ok], y[ok]
        if ranked and joint:
            x, y = x.rank(), y.rank()
        if len(x) >= least and x.std() > 0 and y.std() > 0:
            out.append(np.corrcoef(x, y)[0, 1])
    return np.array(out)


def ndcg(f, y, bins, share):
    out = []
    for d in f.index:
        lab = y.loc[d].dropna().sort_values(kind="stable")
        g = min(bins, len(lab))
        if not len(lab):
            continue
        place = pd.Series(np.arange(1, len(lab) + 1, dtype=float), lab.index)
        rel = pd.qcut(place, g, labels=False) if g > 1 else place * 0
        both = f.loc[d].dropna().index.intersection(lab.index)
        if not len(both):
            continue
        k = max(1, math.ceil(len(both) * share))
        gain = lambda order: sum((2.0 ** rel[n] - 1) / math.log2(i + 2) for i, n in enumerate(order[:k]))  # noqa: E731, B023
        best = gain(sorted(both, key=lambda n: -rel[n]))  # noqa: B023
        if best > 0:
            out.append(gain(sorted(both, key=lambda n: -f.loc[d, n])) / best)  # noqa: B023
    return np.mean(out)


def test_bundle_against_pandas(market):
    p, df = market
    on = wide(df, "tradeable") > 0
    f, y = wide(df, "f").where(on), wide(df, "label").where(on)
    s = Scorer(p, "label", ScorerConfig(ndcg_fraction=0.2, bins=5, steps=("size", "industry"))).score_factor("f")
    ric, ic = daily(f, y, True, 3), daily(f, y, False, 3)
    d = 1 if ric.mean() >= 0 else -1
    assert d == s.direction == -1 and s.days == len(ric)
    assert (s.mean_ic, s.mean_rank_ic) == pytest.approx((ic.mean(), ric.mean()))
    assert (s.ic_ir, s.rank_ic_ir, s.win) == pytest.approx((d * ic.mean() / ic.std(ddof=1), d * ric.mean() / ric.std(ddof=1), (d * ric > 0).mean()))
    best = (d * f).rank(axis=1, pct=True) >= 0.5
    lric, lic = daily((d * f).where(best), y.where(best), True, 3), daily((d * f).where(best), y.where(best), False, 3)
    assert (s.long_rank_ic, s.long_rank_ic_ir, s.long_ic) == pytest.approx((lric.mean(), lric.mean() / lric.std(ddof=1), lic.mean()))
    assert s.ndcg == pytest.approx(ndcg(d * f, y, 5, 0.2)) and s.coverage == pytest.approx((f.notna().sum(axis=1) / on.sum(axis=1)).mean())
    w = pd.DataFrame(0.0, f.index, f.columns)
    for day in f.index:
        order = sorted(f.columns[f.loc[day].notna()], key=lambda n: (-d * f.loc[day, n], n))
        k = max(1, math.ceil(len(order) * 0.2))
        w.loc[day, order[:k]] = 1 / k
    assert s.turnover == pytest.approx((w.diff().abs().sum(axis=1) / 2).iloc[1:].mean())
    after = f.shift(-1)
    assert s.stability == pytest.approx(daily(f, after, False, 3).mean())
    size, group = wide(df, "size"), df.pivot(index=DATE, columns=NAME, values="industry")
    res = pd.DataFrame(np.nan, f.index, f.columns)
    for day in f.index:
        ok = f.loc[day].notna()
        x, v = size.loc[day][ok], f.loc[day][ok]
        r = v - v.mean() - ((x - x.mean()) * (v - v.mean())).sum() / ((x - x.mean()) ** 2).sum() * (x - x.mean())
        res.loc[day, r.index] = r - r.groupby(group.loc[day][ok]).transform("mean")
    nric = daily(res, y, True, 3)
    assert (s.neutral_rank_ic, s.neutral_rank_ic_ir, s.neutral_days) == pytest.approx((nric.mean(), d * nric.mean() / nric.std(ddof=1), len(nric)))
    assert Scorer(p, "label", ScorerConfig(direction=1)).score_factor("f").rank_ic_ir == pytest.approx(-s.rank_ic_ir)


def test_scorer_facade(market):
    p, df = market
    sc = Scorer(p, "label", where=f"{DATE} >= TIMESTAMP '2024-01-10'")
    good, bad = Program(call("neg", field("f"))), Program(field("nothing"))
    a, b, c = sc.score_programs([good, bad, Program(call("add", field("f"), const(1.0)))])
    assert b == EMPTY and a.mean_rank_ic == pytest.approx(-c.mean_rank_ic) and a.direction == 1 and c.direction == -1
    assert a.objectives("structured") == pytest.approx(sc.score_program(good).objectives("structured"))
    v = sc.factor_values(good).toPandas()
    assert v[DATE].min() == pd.Timestamp("2024-01-10 15:00") and len(v) == 31 * 15
    n = sc.neutralize_factor("f", ["industry"])
    assert n.taken == ("industry",) and abs(n.values.toPandas().residual.mean()) < 0.1
    broken = sc.score_columns([lambda p: "f", lambda p: p.let("no_such + 1"), lambda p: 1 / 0 if False else (_ for _ in ()).throw(ValueError("no"))])
    assert [bool(x.error) for x in broken] == [False, True, True]
    with pytest.raises(ValueError, match="nothing"):
        sc.factor_values(bad)


def test_portfolio_literals(spark):
    """Three dates of four names, two groups, no costs: returns, benchmark and ratios by hand."""
    lab = [[0.0, 0.0, 0.04, 0.06], [0.03, 0.01, 0.02, 0.04], [-0.01, -0.01, 0.01, 0.03]]
    p = traded(panel(spark, f=[[1, 2, 3, 4]] * 3, y=lab))
    t = pl.Trading(2, 1, 0.0, 0.0, 0.0)
    long, short, bench = [0.05, 0.03, 0.02], [0.0, 0.02, -0.01], [0.025, 0.025, 0.005]
    got = rows_of(p, pl.long_short(p, "f", "y", t)).collect()
    assert [r.long_ret for r in got] == pytest.approx(long) and [r.short_ret for r in got] == pytest.approx(short) and [r.benchmark for r in got] == pytest.approx(bench)
    perf = {r.series: r for r in rows_of(p, pl.performance(p, "f", "y", t)).collect()}
    sharpe = lambda x: np.mean(x) / np.std(x, ddof=1) * math.sqrt(244)
    assert perf["long"].sharpe == pytest.approx(sharpe(long), abs=1e-5) and perf["long"].excess_sharpe == pytest.approx(sharpe(np.subtract(long, bench)), abs=1e-5)
    assert perf["long_short"].sharpe == pytest.approx(sharpe(np.subtract(long, short)), abs=1e-5) and perf["short"].drawdown == pytest.approx(-0.01) and perf["short"].drawdown_days == 1
    two = rows_of(p, pl.long_short(p, "f", "y", replace(t, every=2))).collect()
    assert len(two) == 2 and [r.d for r in two] == [0, 1]
    best = rows_of(p, pl.top_set_return(p, "f", "y", t)).first()
    assert best.dates == 3 and best.annual == pytest.approx(np.mean(long) * 244)
    assert pl.numeric_entries({"a": 1, "b": float("nan"), "c": True, "d": "x", "e": 2.5}) == {"a": 1.0, "e": 2.5} and pl.top_fraction_groups(0.1) == 10


def test_portfolio_against_pandas(market):
    p, df = market
    on = wide(df, "tradeable") > 0
    f, y = wide(df, "f").where(on), wide(df, "label").where(on)
    t = pl.Trading(3, 4)
    before, want = {}, []
    for k, d in enumerate(f.index[::4]):
        ok = f.columns[f.loc[d].notna() & y.loc[d].notna()]
        order = sorted(ok, key=lambda n: (f.loc[d, n], n))
        if len(order) < 3:
            continue
        g = pd.Series([max(0, -(-i * 3 // (len(order) - 1)) - 1) for i in range(len(order))], order)
        for j in range(3):
            members = set(g.index[g == j])
            turn = len(members ^ before[j]) / (2 * len(members)) if j in before else 0.0
            want.append((k, j, len(members), y.loc[d, list(members)].mean(), turn, y.loc[d, list(members)].mean() - turn * 0.002))
            before[j] = members
    got = [(r.d, r.g, r.members, r.gross, r.turnover, r.net) for r in rows_of(p, pl.group_returns(p, "f", "label", t)).orderBy("d", "g").collect()]
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3:] for x in got], [x[3:] for x in want])


def test_full_neutralisation_leaves_nothing(spark, market):
    """A factor of industry and style alone."""
    style = [[1, 2, 3, 1, 2, 3], [2, 3, 4, 2, 3, 4]]
    f = [[100 * (k > 2) + 2 * s for k, s in enumerate(r)] for r in style]
    p = panel(spark, f=f, s=style, c=[[7] * 6, [7, 7, 7, 7, 7, 8]])
    from pyspark.sql import functions as F

    df = p.base.withColumn("industry", F.when(F.col(NAME) < "C3", "a").otherwise("b"))
    for jointly in (True, False):
        got = rg.neutralise_full(df, "f", ["s"], jointly=jointly, restandardise=True).collect()
        assert max(abs(r.residual) for r in got) < (1e-3 if jointly else 51)
    flat = rg.neutralise_full(df.where(f"{DATE} < '2024-01-02'"), "f", ["s", "c"], jointly=True, restandardise=True).collect()
    assert len(flat) == 6 and max(abs(r.residual) for r in flat) < 1e-3
    assert rg.require_styles(["a"] * 10, True) is None and "10" in rg.require_styles(["a"], True) and "groups" in rg.require_styles(["a"] * 10, False) and rg.require_styles([], False, "none") is None
    with pytest.raises(KeyError):
        rg.size_neutral(df, "f", "market_cap")
    m, pdf = market
    out, picked = rg.neutralise_dynamic(m.base.withColumn("g", F.col("f") * 3 + F.col("size") * 0.1).withColumn("noise", F.rand(3)), "f", ["g", "noise"], restandardise=True)
    assert picked == ["g"]
    r = out.toPandas()
    day = r[r[DATE] == r[DATE].min()].dropna(subset=["f", "g"])
    z = (day.g - day.g.mean()) / day.g.std()
    x = np.column_stack([np.ones(len(z)), z])
    assert np.allclose(day.residual, day.f - x @ np.linalg.lstsq(x, day.f, rcond=None)[0], atol=1e-5)


def test_behaviour_combiners_against_numpy(market):
    """Slots as plain fields: each combiner's arithmetic on the numbers themselves."""
    p, df = market
    df = df.sort_values([DATE, NAME])
    on = df.tradeable.to_numpy()
    v = {c: df[c].where(on).to_numpy(float) for c in ("f", "size", "label")}
    a, b, c = v["f"], v["size"], v["label"]

    def gene(mode, combiner, names):
        return tp.BehaviourGene(mode, combiner, {n: tp.Slot(x, "current") for n, x in zip(names, ("f", "size", "label"), strict=False)}, fixed=False)

    cases = [
        (gene("fund_price_underreaction", "rank_gap", ("fund_anchor", "price_reaction")), a - b),
        (gene("quality_neglect", "quality_gap", ("profit_growth", "cashflow_quality", "price_reaction")), a - b + 0.25 * abs(c)),
        (gene("growth_crowding_risk", "crowding_interaction", ("growth_anchor", "crowding_signal", "fund_support")), a * b - 0.5 * c),
        (gene("growth_crowding_risk", "risk_minus_confirm", ("growth_anchor", "crowding_signal", "fund_support")), b - a - c),
        (gene("fund_flow_confirmation", "confirm", ("fund_anchor", "flow_confirm", "orderbook_filter")), a + b + a * b + 0.5 * c),
        (gene("fund_flow_confirmation", "confirm", ("fund_anchor", "flow_confirm", "price_control")), a + b + a * b - 0.25 * abs(c)),
        (gene("panic_reversal", "panic_reversal", ("fund_anchor", "drawdown", "sell_pressure")), a * b - c),
        (gene("attention_overreaction", "attention_risk", ("attention_heat", "price_momentum", "fund_support")), a + b - c),
        (gene("orderbook_intent", "orderbook_intent", ("orderbook_pressure", "liquidity_stress", "price_reaction")), a - b - 0.25 * abs(c)),
        (gene("liquidity_neglect", "liquidity_gap", ("liquidity_stress", "turnover_shock", "flow_confirm")), a - b - c),
        (gene("anchor_momentum", "anchor_confirm", ("price_anchor", "price_momentum", "flow_confirm")), a + b + a * b + 0.5 * c),
    ]
    q = SparkPanel(p.base)
    cols = [tp.compile_behaviour(q, g) for g, _ in cases]
    got = q.frame(cols).orderBy(DATE, NAME).select(*dict.fromkeys(cols)).toPandas()
    for (g, want), col in zip(cases, cols, strict=True):
        assert np.allclose(got[col].to_numpy(float), want, equal_nan=True), g.combiner
    assert tp.neutralise_industry("all") and tp.neutralise_industry(["a", "b"]) and not any(map(tp.neutralise_industry, (None, "", "banks", ["a"], ["a", " a"])))


def test_structured_modes_against_numpy(market):
    p, df = market
    df = df.sort_values([DATE, NAME])
    on = df.tradeable.to_numpy()
    f, s, y = (df[c].to_numpy(float) for c in ("f", "size", "label"))
    safe = lambda a, b: np.where(np.abs(b) > 0.01, a / np.where(b == 0, 1, b), np.nan)
    by = df[DATE].to_numpy()
    rank = lambda x: pd.Series(x).groupby(by).rank(pct=True).to_numpy() - 0.5
    cases = [
        (tp.StructuredGene("ratio", ("f", "size")), safe(f, s)), (tp.StructuredGene("spread", ("f", "size", "label", "size")), safe(f, s) - safe(y, s)),
        (tp.StructuredGene("pair_ratio", ("f", "size", "size", "f"), left_op="-", right_op="+"), safe(f - s, s + f)), (tp.StructuredGene("style_composite", ("f", "size"), directions=(1, -1)), rank(f) - rank(s)),
    ]
    q = SparkPanel(p.base)
    cols = [tp.compile_structured(q, g) for g, _ in cases]
    got = q.frame(cols).orderBy(DATE, NAME).select(cols).toPandas()
    for (g, want), col in zip(cases, cols, strict=True):
        assert np.allclose(got[col].to_numpy(float), np.where(on, want, np.nan), equal_nan=True), g.mode
