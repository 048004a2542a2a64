"""Sources, builder, recipes, order book, metadata, results and search settings."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import alignment as al
from quillon.operators import configs, folds, orderbook, recipes, results
from quillon.operators import evolve as ev
from quillon.plans import builder
from quillon.plans import rules as ru
from quillon.plans.layers import DATE, NAME, SparkPanel
from quillon.plans.panel import PanelContext, PanelError, densify, storage, validate_wide
from quillon.sources import metadata as md
from quillon.sources import mock, tables

DAYS = [dt.datetime(2024, 1, 1 + i, 15) for i in range(30)]


@pytest.fixture(scope="module")
def mocked(spark):
    return mock.mock_panel(spark, mock.MockShape(dates=90, contracts=12)).cache()


def test_reading_and_writing(spark, tmp_path):
    p = spark.createDataFrame([(d, n, float(i), 1.0) for i, d in enumerate(DAYS) for n in "AB"], f"{DATE} timestamp, {NAME} string, x double, y double")
    tables.write_panel(p, str(tmp_path / "p"))
    assert tables.read_panel(spark, str(tmp_path / "p"), "parquet").count() == 60
    tables.write_panel(p.unionByName(p), str(tmp_path / "q"))
    with pytest.raises(PanelError):
        tables.read_panel(spark, str(tmp_path / "q"), "parquet")
    (tmp_path / "r.csv").write_bytes("﻿name,v\n中文,1\n".encode())
    (tmp_path / "g.csv").write_bytes("name,v\n中文,1\n".encode("gbk"))
    for f in ("r.csv", "g.csv"):
        got = tables.read_results(spark, str(tmp_path / f))
        assert got.columns == ["name", "v"] and got.first()["name"] == "中文"
    assert tables.read_ticks(spark, str(tmp_path / "p"), ["x"], "2024-01-03", "2024-01-04").count() == 4
    for part, shift in (("a", 0.0), ("b", 100.0)):
        p.where(f"day({DATE}) <= 2").withColumn("x", F.col("x") + shift).select(DATE, NAME, "x", *(["y"] if part == "a" else [])).coalesce(1).write.parquet(f"{tmp_path}/parts/{part}")
    got = tables.read_parts(spark, f"{tmp_path}/parts/*", ["x", "y"])
    assert got.count() == 4 and got.agg(F.min("x")).first()[0] == 100.0
    assert tables.month_ranges(dt.date(2024, 1, 15), dt.date(2024, 3, 2)) == [(dt.date(2024, 1, 15), dt.date(2024, 1, 31)), (dt.date(2024, 2, 1), dt.date(2024, 2, 29)), (dt.date(2024, 3, 1), dt.date(2024, 3, 2))]
    tables.write_months(p, f"{tmp_path}/m")
    tables.write_months(p.withColumn("x", F.lit(-1.0)), f"{tmp_path}/m", skip_existing=True)
    assert spark.read.parquet(f"{tmp_path}/m").where("x < 0").count() == 0
    tables.write_months(p.withColumn("x", F.lit(-1.0)), f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").where("x < 0").count() == 60
    tables.write_results(p.select("x"), {"a": 1}, f"{tmp_path}/out")
    assert json.loads(spark.read.text(f"{tmp_path}/out/config").first()[0]) == {"a": 1} and spark.read.option("header", True).csv(f"{tmp_path}/out/results").count() == 60
    assert results.newest(spark, [f"{tmp_path}/p", f"{tmp_path}/out/config", f"{tmp_path}/none"]) == f"{tmp_path}/out/config"


def test_wide_tables(spark):
    w = spark.createDataFrame([(DAYS[0], 1.0, None), (DAYS[1], 2.0, 3.0)], f"{DATE} timestamp, A double, B double")
    assert validate_wide(w) and not validate_wide(w.withColumn("B", F.lit("x")), False) and not validate_wide(w.unionByName(w), False)
    with pytest.raises(PanelError):
        validate_wide(w.withColumn(DATE, F.date_trunc("day", DATE)))
    back = tables.long_to_wide(tables.wide_to_long(w, "v"), "v").orderBy(DATE)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in w.collect()]
    c = PanelContext(label="y", styles=("A",))
    assert c.column(w, "A") is not None and c.matrix(tables.wide_to_long(w, "v"), "v").shape == (2, 2)
    with pytest.raises(KeyError):
        c.column(w, "label")
    with pytest.raises(ValueError, match="cells"):
        c.matrix(tables.wide_to_long(w, "v"), "v", 1)
    assert storage(w)["memory"] is False and storage(w)["partitions"] > 0


def test_alignment_edges(spark):
    reports = spark.createDataFrame([(DAYS[0], "A", 1.0, None), (DAYS[4], "A", None, 5.0), (DAYS[2], "B", 3.0, 3.0)], f"{DATE} timestamp, {NAME} string, u double, v double")
    targets = spark.createDataFrame([(d, n) for d in DAYS[:8] for n in "AB"], f"{DATE} timestamp, {NAME} string")
    got = {(r[NAME], r[DATE].day): (r.u, r.v) for r in al.as_of(reports, targets, ["u", "v"], 3).collect()}
    assert got["A", 4] == (1.0, None) and got["A", 5] == (None, 5.0) and got["A", 8] == (None, 5.0) and got["B", 2] == (None, None) and got["B", 6] == (3.0, 3.0) and got["B", 7] == (None, None) and len(got) == 16
    known = {r[DATE].day: r.known for r in al.business_offset(reports, targets, 2).collect()}
    assert known[1] == DAYS[2] and known[5] == DAYS[6]
    daily = {(r[NAME], r[DATE].day): r.u for r in al.report_to_daily(reports, targets, ["u"], 2).collect()}
    assert daily["A", 2] is None and daily["A", 3] == 1.0 and daily["B", 5] == 3.0
    with pytest.raises(KeyError, match="2030"):
        al.take_dates(targets, spark.createDataFrame([(dt.datetime(2030, 1, 1),)], f"{DATE} timestamp"))
    with pytest.raises(ValueError, match="empty"):
        al.universe(targets, contracts=[])
    with pytest.raises(ValueError, match="before"):
        folds.rolling_windows(targets, "2024-01-02", "2024-01-02")
    with pytest.raises(ValueError, match="stride"):
        folds.Rolling(0)
    a, b = folds.split(targets, 0.5, 1)
    assert (a.agg(F.max(DATE)).first()[0], b.agg(F.min(DATE)).first()[0]) == (DAYS[3], DAYS[5]) and folds.split_at(targets, "2024-01-03")[0].count() == 4
    windows = folds.rolling_windows(targets, "2024-01-01", "2024-01-05", folds.Rolling(3, 1, "expanding")).orderBy("window").collect()
    assert [(w.train_start.day, w.train_end.day, w.test_start.day, w.test_end.day) for w in windows] == [(1, 3, 5, 7), (1, 6, 8, 8)]


def test_builder(spark, mocked):
    p = densify(mocked)
    pick = lambda *c: p.select(DATE, NAME, *c)
    wide = tables.long_to_wide(pick("price"), "price")
    rare = pick(F.when(F.rand(1) < 0.1, F.lit(1.0)).alias("rare"), "volume")
    built = builder.build_panel(
        builder.Values(pick("industry")), builder.Values(pick("market_cap", "amount"), "market_cap"), [builder.Factors(pick("turnover", "volume"), "price_table", prefix="pv_"), builder.Factors(rare, "other_table"), builder.Factors(pick("profit_growth").where(f"day({DATE}) = 1"), "income", limit=40)],
        groups=["ind0", "ind1"], close=builder.Values(wide), tradeable=builder.Values(pick(F.col("tradeable").cast("int").alias("flag"))), horizon=3, choice=builder.Choice(exclude=["volume"], least_uniques=3, most=3),
    )
    assert built.fields == ("pv_turnover", "pv_volume", "profit_growth") or set(built.fields) == {"pv_turnover", "pv_volume"}
    prof = {r.name: r for r in built.profile.collect()}
    assert prof["pv_turnover"].coverage == 1.0 and prof["rare"].coverage < 0.3 and prof["rare"].table == "other_table" and prof["profit_growth"].table_kind == "financial_statement"
    got = built.panel.toPandas()
    whole = p.toPandas().pivot(index=DATE, columns=NAME, values="price")
    want = (whole.shift(-3) / whole - 1).stack()
    joined = got.set_index([DATE, NAME]).label.dropna()
    assert len(joined) and np.allclose(joined, want.reindex(joined.index)) and set(got.industry) == {"ind0", "ind1"} and got.tradeable.dtype == bool
    assert built.metadata["n_dates"] == 90 and built.metadata["rows"] == len(got)
    with pytest.raises(ValueError, match="universe"):
        builder.build_panel(builder.Values(pick("industry")), builder.Values(pick("market_cap")), groups=["none"], close=builder.Values(wide))
    with pytest.raises(ValueError, match="label"):
        builder.build_panel(builder.Values(pick("industry")), builder.Values(pick("market_cap")))
    with pytest.raises(ValueError, match="which"):
        builder.Values(pick("market_cap", "amount")).read("size")
    assert builder.table_kind("rq_balance_sheet") == "financial_statement" and builder.draft_rule("net_profit", "financial_statement", 0.99)["allow_log"] and not builder.draft_rule("roe_ratio", "other", 1.0)["allow_pct"]


def test_recipes_against_pandas(spark, mocked):
    names = [n for k in ("valuation", "growth", "technical") for n in recipes.CATALOGUES[k]]
    df = mocked.select(DATE, NAME, *[(mock.normal(k, "r", NAME, DATE) + 2).alias(n) for k, n in enumerate(names)])
    df = df.withColumn("ep_ratio_ttm", F.when(mock.uniform(1, "gap", NAME, DATE) > 0.1, F.col("ep_ratio_ttm")))
    p = SparkPanel(df)
    made = recipes.derive(p)
    assert {"ep_revaluation", "value_composite_rank", "rev_growth_accel", "ma_5_20_spread", "overbought_consensus", "aroon_trend_confirmed"} <= set(made) and "leverage_change" not in made
    got = p.frame(list(made.values())).toPandas().sort_values([NAME, DATE]).set_index([DATE, NAME])
    x = got[names].astype(float)
    rank = lambda c: x[c].groupby(level=DATE).rank(pct=True) if isinstance(c, str) else c.groupby(level=DATE).rank(pct=True)
    spread = lambda a, b: x[a] / x[b].where(x[b].abs() > 1e-12) - 1
    value = pd.concat([rank(c) for c in recipes.VALUE_RANKED], axis=1)
    ma, vol = spread("MA5", "MA20"), spread("VOL5", "VOL20")
    over = pd.concat([rank(c) for c in recipes.REVERSAL], axis=1)
    rev = x["net_profit_growth_ratio_lyr"].groupby(level=NAME).diff()
    want = {
        "ep_revaluation": x.ep_ratio_ttm - x.ep_ratio_lyr, "value_composite_rank": value.mean(axis=1), "deep_value_score": value.min(axis=1), "valuation_dispersion": value.std(axis=1), "valuation_consensus": value.gt(0.7).sum(axis=1),
        "ma_5_20_spread": ma, "price_volume_divergence_5_20": rank(ma) - rank(vol), "crowded_momentum_risk": rank(ma) * rank(vol) * rank("RSI6"), "overbought_consensus": over.mean(axis=1), "oversold_extreme_count": over.lt(0.2).sum(axis=1),
        "panic_oversold_score": rank(x.MDD20.abs()) * rank(x.ATR.abs()) * (1 - over.mean(axis=1)), "net_profit_growth_last_revision": rev.where(rev.abs() > 0).groupby(level=NAME).ffill(), "net_profit_growth_update_flag": (rev.abs() > 0).astype(float),
        "macd_vol_adjusted": x.MACD_HIST / x.ATR.abs(), "aroon_trend_confirmed": rank(x.AROON_UP - x.AROON_DOWN) * rank("ADX"),
    }
    for k, w in want.items():
        assert np.allclose(got[k].astype(float), w, equal_nan=True), k
    assert {k: len(v) for k, v in recipes.CATALOGUES.items()} == {"growth": 33, "valuation": 26, "structure": 58, "operating": 43, "cash_flow": 12, "technical": 126}
    ranked = recipes.global_rank_pct(df.select(DATE, NAME, F.round("MA5", 1).alias("v")), "v", buckets=8).toPandas()
    assert np.allclose(ranked.v_global_rank, ranked.v.rank(pct=True))


def test_flows_against_pandas(spark, mocked):
    p = SparkPanel(mock.mock_flows(mocked))
    made = recipes.money_flow(p)
    pv = recipes.price_volume(p, "price", "high", "low", "amount", "volume", "turnover")
    cross = recipes.derive(p)
    assert len(made) == 8 + 3 + 8 + 1 + 4 + 12 - 4 + 12 or len(made) == 48
    assert set(cross) >= {"flow_price_divergence_5d", "retail_chase_risk", "moneyflow_crowding_risk"} and "liquidity_neglect" not in cross
    got = p.frame([*made.values(), *pv.values(), *cross.values()]).toPandas().sort_values([NAME, DATE]).set_index([DATE, NAME])
    total = sum(got[f"{s}_{z}_amount"] for s in ("buy", "sell") for z in recipes.SIZES)
    by = lambda s: s.groupby(level=NAME)
    roll = lambda s, w, f="sum", least=None: getattr(by(s).rolling(w, min_periods=least or w), f)().droplevel(0)
    large = got.mf_net_lg_amount + got.mf_net_elg_amount
    want = {
        "mf_net_amount_ratio": got.mf_net_amount / total, "mf_large_net_ratio": large / total, "mf_lg_s2": got.mf_net_lg_amount / got.buy_lg_amount, "mf_sm_s3": np.sign(got.mf_net_sm_amount),
        "mf_large_net_ratio_5d": roll(large, 5) / roll(total, 5), "mf_large_positive_days_20d": roll((large / total > 0).astype(float), 20, "mean"), "mf_active_imbalance_std_5d": roll(got.mf_buy_amount_total / got.mf_sell_amount_total, 5, "std"),
        "ret_5d": by(got.price).pct_change(5), "volume_shock_5_20": roll(got.volume, 5, "mean", 2) / roll(got.volume, 20, "mean", 6) - 1, "range_std_20d": roll((got.high - got.low) / got.price, 20, "std", 6),
    }
    for k, w in want.items():
        assert np.allclose(got[k].astype(float), w.reindex(got.index).astype(float), equal_nan=True), k
    r = lambda c: got[c].groupby(level=DATE).rank(pct=True) - 0.5
    assert np.allclose(got.retail_chase_risk.astype(float), r("ret_5d") + r("mf_sm_net_ratio_5d") - r("mf_large_net_ratio_5d"), equal_nan=True)
    styles = mock.mock_styles(mock.mock_book(mocked)).toPandas()
    for s in mock.STYLES:
        z = styles.groupby(DATE)[f"style_{s}"]
        assert z.mean().abs().max() < 1e-8 and not styles[f"style_{s}"].isna().any()
    assert styles.ob_close_chase_pressure.notna().all()


def test_order_book_against_pandas(spark):
    r = np.random.default_rng(6)
    rows = [(dt.datetime(2024, 1, 2 + d, 9, 30) + dt.timedelta(minutes=5 * k), n, *[float(x) for x in (100 + r.random(), 100.5 + r.random(), *r.integers(0, 50, 10))]) for d in range(2) for n in "AB" for k in range(67)]
    ticks = spark.createDataFrame(rows, f"{DATE} timestamp, {NAME} string, " + ", ".join(f"{c} double" for c in orderbook.FIELDS))
    got = orderbook.book_days(ticks).toPandas().sort_values([DATE, NAME]).set_index([DATE, NAME])
    x = ticks.toPandas()
    t = x[DATE].dt.strftime("%H:%M")
    x = x[((t >= "09:35") & (t <= "11:30")) | ((t >= "13:05") & (t <= "15:00"))].sort_values([NAME, DATE]).reset_index(drop=True)
    bid, ask = (x[[f"{s}V{k}" for k in range(1, 6)]].sum(axis=1) for s in "BS")
    x["ob_spread"] = (x.SP1 - x.BP1) / ((x.SP1 + x.BP1) / 2)
    x["ob_imbalance_5"] = (bid - ask) / (bid + ask)
    day = x[DATE].dt.normalize()
    x["ob_net_bid_change_5"] = bid.groupby([day, x[NAME]]).diff() - ask.groupby([day, x[NAME]]).diff()
    x["at"], x["day"] = x[DATE].dt.strftime("%H:%M"), day + pd.Timedelta("15h")
    late = x[(x["at"] >= "14:35") & (x["at"] <= "15:00")]
    for m in ("ob_spread", "ob_imbalance_5", "ob_net_bid_change_5"):
        for part, d in (("full", x), ("close30", late)):
            g = d.groupby(["day", NAME])[m]
            for k in ("mean", "std", "skew", "last", "max", "min"):
                assert np.allclose(got[f"{m}_{part}_{k}"].astype(float), getattr(g, k)().astype(float), equal_nan=True), (m, part, k)
    assert len(got.columns) == 12 * 6 * 5 + 4 and len(orderbook.KEPT) == 32 and set(orderbook.KEPT) <= set(got.columns)


def test_results(spark, tmp_path):
    cells = spark.createDataFrame([(0, '["a", " b"]'), (1, "['a', 'b']"), (2, "a, b,,"), (3, ""), (4, None), (5, "(x)")], "i int, c string")
    assert [r[0] for r in cells.orderBy("i").select(results.parse_list("c")).collect()] == [["a", "b"], ["a", "b"], ["a", "b"], [], [], ["x"]]
    assert results.unique_names(["b", " a", None, "b", ""]) == ["b", "a"]
    genes = spark.createDataFrame([(1, "m", '[{"slot": "s", "field": "f", "transform": "t", "direction": 1}]', None), (2, "m", "junk", '[{"field": "g", "kind": "positive", "threshold": 0.5, "transform": "t"}]')], "id int, mode string, gene_slots string, gene_conditions string")
    meta = spark.createDataFrame([("f", "fam", "k")], "field string, family string, kind string")
    made = results.analyse(genes, "id", "mode", meta, str(tmp_path / "a"))
    assert {(r.field, r.family, r.n) for r in made["fields"].collect()} == {("f", "fam", 1), ("g", "unknown", 1)}
    assert spark.read.option("header", True).csv(str(tmp_path / "a/levels")).where("level = 'slot'").count() == 2
    e = spark.createDataFrame([("add(ts_mean_5(x), -1.5)",), ("x_1",)], "expression string")
    assert [r[0] for r in e.select(results.fields_in("expression")).collect()] == [["x"], ["x_1"]]


def test_metadata(spark, mocked, tmp_path):
    text = "# Doc\n## 7 Fields\n| field | meaning |\n|---|---|\n| `roe` | return |\n| ret_5d | move |\n\n```\nob_spread_full_mean, mf_large\n```\n## 8 Other\n| x | y |\n|---|---|\n| zzz | no |\n"
    assert md.markdown_fields(text, "7") == {"roe": {"meaning": "return"}, "ret_5d": {"meaning": "move"}, "ob_spread_full_mean": {}, "mf_large": {}} and "zzz" in md.markdown_fields(text)
    rules = md.behaviour_metadata(["profit_growth", "ret_5d", "mf_large", "ob_spread_full_mean", "plain"])
    assert {k: v["data_family"] for k, v in rules.items()} == {"profit_growth": "fundamental", "ret_5d": "price_volume", "mf_large": "moneyflow", "ob_spread_full_mean": "orderbook", "plain": "control"}
    assert "price_momentum" in rules["ret_5d"]["allowed_slots"] and "fund_anchor" in rules["profit_growth"]["allowed_slots"] and md.candidates(rules, "large_flow") == ["mf_large"] and not rules["plain"]["conditions"]
    new, added, dropped = md.sync({"ret_5d": {"kept": True}, "gone": {}}, ["ret_5d", "roe"])
    assert new["ret_5d"] == {"kept": True} and (added, dropped) == (["roe"], ["gone"])
    (tmp_path / "s.csv").write_text("field,score\nroe,1\nroe,2\nret_5d,3\n")
    md.main([str(tmp_path / "s.csv"), str(tmp_path / "o.json")])
    assert json.loads((tmp_path / "o.json").read_text())["selected_fields"] == ["roe", "ret_5d"]
    (tmp_path / "d.md").write_text(text)
    md.main([str(tmp_path / "d.md"), str(tmp_path / "m.json"), "--known", str(tmp_path / "o.json")])
    assert "roe" in json.loads((tmp_path / "m.json").read_text())["field_rules"]
    assert md.panel_metadata(mocked)["n_contracts"] == 12 and "ep_revaluation" in md.recipe_names() and len(md.recipe_names()) > 90


def test_samplers_keep_to_slots_and_weights():
    names = ["profit_growth", "roe_quality", "ret_5d", "volume_5", "mf_large", "mf_small", "ob_spread", "ob_pressure", "plain"]
    rules = ru.infer_rules(names)
    s = ru.Sampler(rules, 4, weights={"panic_reversal": 1.0})
    for _ in range(30):
        g = s.behaviour()
        assert g.mode == "panic_reversal" and all(x.source in ru.slot_fields(rules, k) for k, x in g.slots.items()) and all(c.field != "plain" for c in g.conditions)
    assert ru.slot_fields(rules, "drawdown") == ["ret_5d", "volume_5"] and ru.slot_fields(ru.infer_rules(["plain"]), "drawdown") == ["plain"]
    for bad in ({"weights": {"nothing": 1.0}}, {"optional": 2.0}, {"thresholds": ()}):
        with pytest.raises(ValueError, match="are"):
            ru.Sampler(rules, **bad)


@pytest.mark.parametrize("kind", ["structured", "tree"])
def test_search_by_objectives(spark, mocked, kind):
    p = SparkPanel(densify(mocked).withColumn("tradeable", F.coalesce("tradeable", F.lit(False))))
    fields = ru.infer_rules(["imbalance", "turnover", "flow_large", "profit_growth", "book_to_price"])
    s = configs.DEFAULTS[kind]
    small = configs.SearchSettings(kind, 4, 1, objectives=s.objectives, sampler=s.sampler, size_weight=s.size_weight, weights={"single": 1.0} if kind == "structured" else None)
    got = configs.run(p, small, fields, train=f"{DATE} < TIMESTAMP '2020-04-01'", later=f"{DATE} >= TIMESTAMP '2020-04-01'")
    rows = got.collect()
    assert rows and "later_rank_ic" in got.columns and sum(c.startswith("goal_") for c in got.columns) == 3 and [r.front for r in rows] == sorted(r.front for r in rows)


def test_settings_are_checked():
    for bad in ({"kind": "other"}, {"kind": "tree", "population": 0}, {"kind": "tree", "crossover": 1.5}, {"kind": "tree", "ndcg_fraction": 0}, {"kind": "tree", "objectives": "x"}, {"kind": "tree", "size_weight": -1}):
        with pytest.raises(ValueError, match="."):
            configs.SearchSettings(**bad)
    assert configs.SearchSettings("structured", industry="all", size=True).steps == ("industry", "size") and ev.Criteria().least_ic == 0.02
