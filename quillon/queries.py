"""Registered queries of the panel engine.

A query is written once against ``Layers`` and returns a DataFrame on Spark or SQL text for the second engine, so that
results can be held against each other. Names follow the operator inventory.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillon.functions import cross_section as cs
from quillon.functions import masks
from quillon.functions import pointwise as pw
from quillon.functions import time_series as ts
from quillon.functions.registry import OPERATORS
from quillon.operators import compare as cmp
from quillon.operators import features as fe
from quillon.operators import metrics as mt
from quillon.operators import portfolio as pl
from quillon.operators import recipes as rc
from quillon.operators import scorer as sc
from quillon.plans import templates as tp
from quillon.plans.layers import DATE, NAME, Layers
from quillon.plans.panel import weekly_panel, weekly_text
from quillon.plans.program import Program, call, compile_program, const, field

Build = Callable[[Layers], Any]
PANEL: dict[str, Build] = {}
KEYS = {DATE: DATE, NAME: NAME}


def panel_query(name: str) -> Callable[[Build], Build]:
    def add(f: Build) -> Build:
        PANEL[name] = f
        return f

    return add


def _cells(name: str, **columns: Callable[[Layers], str]) -> None:
    """A query of columns over all cells of the panel."""
    PANEL[name] = lambda p: p.select(KEYS | {k: f(p) for k, f in columns.items()})


def _scaled(p: Layers) -> tuple[str, str]:
    """Two computed fields with gaps: log price where tradeable, and log volume."""
    x = p.let("CASE WHEN tradeable THEN ln(price) END")
    return x, p.let("ln(1 + volume)")


# Layout, filters, alignment.
_cells("pf6_dense_grid", cell=lambda p: p.let("CASE WHEN tradeable THEN 1.0E0 ELSE 0.0E0 END"), price=lambda p: "price")
_cells("pf8_tradeable_mask", price=lambda p: masks.tradeable_only(p, "price"))


@panel_query("pf9_date_subset")
def _(p):
    return p.select(KEYS | {"mean5": ts.ts_mean(p, "price", 5)}, f"{DATE} >= TIMESTAMP '1998-01-01' AND {DATE} < TIMESTAMP '1999-01-01'")


@panel_query("pf13_universe_filter")
def _(p):
    return p.select(KEYS | {"price": "price"}, "industry IN ('r0', 'r3') AND tradeable")


@panel_query("pf12_session_filter")
def _(p):
    hhmm = "date_format(ts, 'HH:mm')" if p.dialect == "spark" else "strftime(ts, '%H:%M')"
    sql = f"SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE ({hhmm} BETWEEN '09:35' AND '11:30') OR ({hhmm} BETWEEN '13:05' AND '15:00')"
    return p.spark.sql(sql) if p.dialect == "spark" else sql


@panel_query("pf14_column_selection")
def _(p):
    parts = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) * 1.0E0 / count(*) AS coverage, count(DISTINCT {c}) AS uniques FROM {{panel}}" for c in ("price", "volume", "amount", "label", "lines"))
    return p.query(f"SELECT name, round(coverage, 6) AS coverage, uniques, row_number() OVER (ORDER BY coverage DESC, name) AS place FROM ({parts}) q WHERE coverage >= 0.5 AND uniques > 10", ["price", "volume", "amount", "label", "lines"])


@panel_query("jn5_outer_concat")
def _(p):
    sql = f"""SELECT coalesce(a.{DATE}, b.{DATE}) AS {DATE}, coalesce(a.{NAME}, b.{NAME}) AS {NAME}, a.price, b.volume
      FROM (SELECT {DATE}, {NAME}, price FROM {{panel}} WHERE industry <> 'r1') a FULL OUTER JOIN (SELECT {DATE}, {NAME}, volume FROM {{panel}} WHERE tradeable) b
      ON a.{DATE} = b.{DATE} AND a.{NAME} = b.{NAME}"""
    return p.query(sql, ["price", "volume"])


@panel_query("jn1_inner_align")
def _(p):
    sql = f"SELECT a.{DATE}, a.{NAME}, a.price, b.volume FROM (SELECT * FROM {{panel}} WHERE industry <> 'r1') a JOIN (SELECT * FROM {{panel}} WHERE tradeable) b ON a.{DATE} = b.{DATE} AND a.{NAME} = b.{NAME}"
    return p.query(sql, ["price", "volume"])


@panel_query("jn2_right_align")
def _(p):
    sql = f"SELECT l.{DATE}, l.{NAME}, l.label, f.price FROM (SELECT {DATE}, {NAME}, label FROM {{panel}} WHERE label IS NOT NULL) l LEFT JOIN (SELECT {DATE}, {NAME}, price FROM {{panel}} WHERE tradeable) f ON l.{DATE} = f.{DATE} AND l.{NAME} = f.{NAME}"
    return p.query(sql, ["price", "label"])


@panel_query("jn6_tradeable_fill")
def _(p):
    sql = f"SELECT a.{DATE}, a.{NAME}, coalesce(b.flag, 0) AS flag FROM {{panel}} a LEFT JOIN (SELECT {DATE}, {NAME}, 1 AS flag FROM {{panel}} WHERE tradeable AND lines > 1) b ON a.{DATE} = b.{DATE} AND a.{NAME} = b.{NAME}"
    return p.query(sql, ["lines"])


@panel_query("jn8_asof_forward_fill")
def _(p):
    """Quarterly reports (orders by nation) carried forward to weeks, at most 26 of them."""
    quarter = "date_trunc('quarter', o_orderdate)"
    reports = f"SELECT c_nationkey AS nation, date_trunc('week', {quarter}) AS day0, sum(o_totalprice) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, date_trunc('week', {quarter})"
    last = lambda x: f"last_value({x}) IGNORE NULLS" if p.dialect == "spark" else f"last_value({x} IGNORE NULLS)"
    over = "OVER (PARTITION BY nation ORDER BY day0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    sql = f"""WITH reports AS ({reports}), days AS (SELECT DISTINCT {DATE} AS day0 FROM {{panel}}), nations AS (SELECT DISTINCT nation FROM reports),
      times AS (SELECT n.nation, d.day0 FROM nations n CROSS JOIN days d UNION SELECT nation, day0 FROM reports),
      rows0 AS (SELECT t.nation, t.day0, r.total, r.orders, row_number() OVER (PARTITION BY t.nation ORDER BY t.day0) AS i FROM times t LEFT JOIN reports r ON t.nation = r.nation AND t.day0 = r.day0),
      carried AS (SELECT nation, day0, i, {last('total')} {over} AS total, {last('orders')} {over} AS orders, max(CASE WHEN orders IS NOT NULL THEN i END) {over} AS seen FROM rows0)
      SELECT f.nation, f.day0 AS {DATE}, CASE WHEN i - seen <= 26 THEN round(f.total, 2) END AS total, CAST(CASE WHEN i - seen <= 26 THEN f.orders END AS DOUBLE) AS orders FROM carried f JOIN days d ON f.day0 = d.day0"""
    return p.query(sql.replace("rows0", "numbered"), ["price"])


# Element-wise.
_cells("pw1_5_unary", neg=lambda p: pw.neg(p, "label"), absolute=lambda p: pw.absolute(p, "label"), sign=lambda p: pw.sign(p, "label"), slog=lambda p: pw.slog(p, "label"), sqrt_abs=lambda p: pw.sqrt_abs(p, "label"))
_cells("pw6_9_binary", plus=lambda p: pw.add(p, *_scaled(p)), minus=lambda p: pw.sub(p, *_scaled(p)), times=lambda p: pw.mul(p, *_scaled(p)), qdiv=lambda p: pw.divide(p, *_scaled(p)))
_cells("pw10_13_divisions", coarse=lambda p: pw.divide(p, "price", "discount", pw.STRUCTURED_EPS), fine=lambda p: pw.divide(p, "tax", "discount", pw.RECIPE_EPS), nonzero=lambda p: pw.divide_nonzero(p, "discount", "tax"))
_cells("pw14_16_tree", clip=lambda p: pw.clip(p, p.let("label * 100")), mean=lambda p: pw.mean_of_two(p, *_scaled(p)), diff=lambda p: pw.sub(p, "tax", "discount"), interaction=lambda p: pw.mul(p, "tax", "discount"))
_cells("pw17_clean", clean=lambda p: pw.finite(p, p.let("CAST(label AS DOUBLE)")), constant=lambda p: pw.constant(p, 2.5))
_ROW = ["label", "tax", "discount"]
_cells("pw18_row_wise", mean=lambda p: pw.row_mean(p, _ROW), low=lambda p: pw.row_min(p, _ROW), std=lambda p: pw.row_std(p, _ROW), above=lambda p: pw.row_count_above(p, _ROW, 0.05))

# Cross-section.
_cells("cs1_3_ranks", rank=lambda p: cs.average_rank(p, _scaled(p)[0]), pct=lambda p: cs.rank_pct(p, _scaled(p)[0]), centred=lambda p: cs.centred_rank(p, "volume"))
_cells("cs4_zscore", z=lambda p: cs.zscore(p, _scaled(p)[0]))
_cells("cs5_zscore_zero", z=lambda p: cs.zscore(p, _scaled(p)[0], flat="zero"), fine=lambda p: cs.zscore(p, _scaled(p)[0], eps=1e-12))
_cells("cs7_demean", d=lambda p: cs.demean(p, _scaled(p)[0]))
_cells("cs8_9_winsorize", q25=lambda p: cs.quantile(p, _scaled(p)[0], 0.25), w=lambda p: cs.winsorize(p, _scaled(p)[0]))
_cells("cs10_industry_rank", r=lambda p: cs.rank_pct(p, _scaled(p)[0], "industry"))
_cells("cs11_industry_zscore", z=lambda p: cs.zscore(p, _scaled(p)[0], "industry"))
_cells("cs12_14_industry_demean", d=lambda p: cs.demean(p, _scaled(p)[0], "industry"), s1=lambda p: cs.demean(p, cs.zscore(p, "size"), "industry"), s2=lambda p: cs.zscore(p, "discount"))
_cells("cs15_plain_zscore", z=lambda p: cs.zscore(p, _scaled(p)[0], eps=0.0))
_cells("cs16_zscore_fill", z=lambda p: p.let(f"coalesce({cs.zscore(p, _scaled(p)[0])}, 0)"))


@panel_query("cs17_one_hot")
def _(p):
    cols = cs.one_hot(p, "industry", ["r0", "r1", "r2", "r3", "r4"])
    return p.select(KEYS | {f"d{i + 1}": c for i, c in enumerate(cols)})


# Regression.
_cells("rg1_residual_demean", r=lambda p: cs.residual(p, *_scaled(p), flat="demean"))
_cells("rg2_residual", r=lambda p: cs.residual(p, *_scaled(p)))
_cells("rg4_residual_two_controls", r=lambda p: cs.residual_two(p, _scaled(p)[0], cs.zscore(p, "size"), cs.zscore(p, "discount")))
_cells("rg7_style_and_industry", r=lambda p: cs.residual_two(p, *[cs.demean(p, c, "industry") for c in (_scaled(p)[0], cs.zscore(p, "size"), cs.zscore(p, "discount"))]))
_cells("rg8_style_then_industry", r=lambda p: cs.demean(p, cs.residual_two(p, _scaled(p)[0], cs.zscore(p, "size"), cs.zscore(p, "discount")), "industry"))
_cells("rg10_size_neutral", r=lambda p: cs.residual(p, _scaled(p)[0], "size", flat="demean"), logged=lambda p: cs.residual(p, _scaled(p)[0], pw.slog(p, "amount"), flat="demean"))
_cells("rg11_size_then_industry", a=lambda p: tp.neutralise(p, _scaled(p)[0], ("size", "industry")), b=lambda p: tp.neutralise(p, _scaled(p)[0], ("industry", "size")), c=lambda p: tp.neutralise(p, _scaled(p)[0], ()))


@panel_query("rg9_style_correlation")
def _(p):
    return p.query(*mt.style_correlation_sql(p, _scaled(p)[0], ["size", "discount", "tax"]))


# Time series.
for _w in ts.WINDOWS:
    _cells(f"ts1_3_lags_{_w}", delay=lambda p, w=_w: ts.delay(p, _scaled(p)[0], w), delta=lambda p, w=_w: ts.ts_delta(p, "price", w), ret=lambda p, w=_w: ts.ts_return(p, "price", w))
    _cells(f"ts5_6_mean_std_{_w}", mean=lambda p, w=_w: ts.ts_mean(p, "price", w), std=lambda p, w=_w: ts.ts_std(p, "price", w), gaps=lambda p, w=_w: ts.ts_mean(p, _scaled(p)[0], w))
    _cells(f"ts7_median_{_w}", median=lambda p, w=_w: ts.ts_median(p, "price", w))
    _cells(f"ts8_9_zscore_range_{_w}", z=lambda p, w=_w: ts.ts_zscore(p, "price", w), spread=lambda p, w=_w: ts.ts_max_to_min(p, "price", w))
    _cells(f"ts10_11_meanrank_sign_{_w}", meanrank=lambda p, w=_w: ts.ts_meanrank(p, "price", w), sign=lambda p, w=_w: ts.diff_sign(p, "price", w))
    _cells(f"ts12_13_corr_{_w}", corr=lambda p, w=_w: ts.ts_corr(p, "price", "volume", w))
    _cells(f"ts14_selmean_{_w}", n1=lambda p, w=_w: ts.rolling_selmean_diff(p, "label", "volume", w, 1), n3=lambda p, w=_w: ts.rolling_selmean_diff(p, "label", "volume", w, 3))
    _cells(f"ts15_decay_{_w}", decay=lambda p, w=_w: ts.decay_linear(p, "price", w), gaps=lambda p, w=_w: ts.decay_linear(p, _scaled(p)[0], w))
_cells("ts16_partial_zscore", z5=lambda p: ts.ts_zscore_partial(p, _scaled(p)[0], 5), z20=lambda p: ts.ts_zscore_partial(p, _scaled(p)[0], 20))
_cells("ts17_18_changes", diff_2q=lambda p: ts.ts_delta(p, "price", 120), pct_2q=lambda p: ts.pct_change(p, "price", 120), diff_1y=lambda p: ts.ts_delta(p, "price", 244), pct_1y=lambda p: ts.pct_change(p, "price", 244))
_cells("ts19_rolling_lenient", mean=lambda p: ts.ts_mean(p, _scaled(p)[0], 20, 6), std=lambda p: ts.ts_std(p, _scaled(p)[0], 20, 6))
_cells("ts20_forward_return", r1=lambda p: ts.forward_return(p, "price", 1), r5=lambda p: ts.forward_return(p, "price", 5), r20=lambda p: ts.forward_return(p, "price", 20))
_cells("ts21_ffill", plain=lambda p: ts.ffill(p, "lines"), limited=lambda p: ts.ffill(p, "lines", 2))
_cells("ts22_revision", last=lambda p: ts.last_revision(p, "price"), flag=lambda p: ts.update_flag(p, "price"))
_cells("ts23_24_sums", ttm=lambda p: ts.ts_sum(p, "volume", 4), ratio=lambda p: ts.sum_ratio(p, "amount", "volume", 20))
_cells("ts25_market_corr", r=lambda p: ts.market_corr(p, "price", 60))
_cells("ts26_drawdown_vwap", dd=lambda p: ts.drawdown(p, "price", 60), vwap=lambda p: ts.vwap_gap(p, "price", "amount", "volume", 60), skip=lambda p: ts.pct_change(p, ts.delay(p, "price", 20), 60))

# Masks, gates, conditions.
_cells("mg1_3_masks", high50=lambda p: masks.rank_high(p, _scaled(p)[0], 0.5), high80=lambda p: masks.rank_high(p, _scaled(p)[0], 0.8), low20=lambda p: masks.rank_low(p, _scaled(p)[0], 0.2), pos=lambda p: masks.sign_pos(p, "label"), neg=lambda p: masks.sign_neg(p, "label"))
_cells("mg4_5_gates", nan=lambda p: masks.gate_nan(p, "price", masks.rank_high(p, _scaled(p)[0], 0.5)), zero=lambda p: masks.gate_zero(p, "label", masks.sign_pos(p, _scaled(p)[1])))
_cells("mg6_conditions", **{k: (lambda p, k=k: masks.condition(p, "label", k)) for k in masks.CONDITIONS})
_cells("mg7_gate_all", nan=lambda p: masks.gate_all(p, "price", [masks.sign_pos(p, "label"), masks.rank_high(p, "volume", 0.5)]), zero=lambda p: masks.gate_all(p, "price", [masks.sign_pos(p, "label")], "zero"))
_cells("mg8_10_top", mask=lambda p: masks.as_mask(p, "discount"), half=lambda p: masks.top_half(p, "price"), top5=lambda p: masks.top_k(p, "price", 5), tenth=lambda p: masks.top_k(p, "price"))

# Vocabularies.
_cells("uv1_structured", **{k: (lambda p, k=k: tp.STRUCTURED[k](p, "price")) for k in tp.STRUCTURED})
_cells("uv2_behaviour", **{k: (lambda p, k=k: tp.BEHAVIOUR[k](p, _scaled(p)[0], -1)) for k in tp.BEHAVIOUR})
_cells("uv3_tree_unary", **{f"t_{k}": (lambda p, k=k: tp.TREE_UNARY[k](p, "label")) for k in tp.TREE_UNARY})
_cells("uv4_tree_binary", **{f"t_{k}": (lambda p, k=k: tp.TREE_BINARY[k](p, "tax", "discount")) for k in tp.TREE_BINARY})

# Structured genes, one query per mode.
for _mode, _gene in {
    "single": tp.StructuredGene("single", ("price",), ("rank_pct",)),
    "ratio": tp.StructuredGene("ratio", ("price", "discount"), industry=True),
    "pair_ratio": tp.StructuredGene("pair_ratio", ("high", "low", "price", "volume"), left_op="-"),
    "resi": tp.StructuredGene("resi", ("price", "volume"), ("zscore", "log")),
    "resi_pair": tp.StructuredGene("resi_pair", ("price", "volume", "discount"), ("zscore", "zscore", "zscore")),
    "multi_resi": tp.StructuredGene("multi_resi", ("price", "volume", "discount", "tax"), ("zscore",) * 4, size=True),
    "spread": tp.StructuredGene("spread", ("high", "price", "low", "price")),
    "style_composite": tp.StructuredGene("style_composite", ("price", "volume"), directions=(1, -1), industry=True, size=True),
}.items():
    _cells(f"sx_{_mode}", factor=lambda p, g=_gene: tp.compile_structured(p, g))

# Behaviour genes, one query per mode and combiner.
_SLOT_FIELDS = ("price", "volume", "discount", "tax")
for _mode, _m in tp.MODES.items():
    for _combiner in _m.combiners:
        _slots = {s.rstrip("?"): tp.Slot(f, "rank_pct" if i else "zscore") for i, (s, f) in enumerate(zip(_m.slots, _SLOT_FIELDS, strict=False))}
        _gated = _combiner.startswith("gated")
        _gene2 = tp.BehaviourGene(_mode, _combiner, _slots, (tp.Condition("amount", "above_median"),) if _gated else ())
        _cells(f"bh_{_mode}_{_combiner}", factor=lambda p, g=_gene2: tp.compile_behaviour(p, g), neutral=lambda p, g=_gene2: tp.compile_behaviour(p, g, ("size", "industry")))
_TREE = tp.Tree("interaction", (tp.Tree("rank", (tp.Tree("", leaf="price"),)), tp.Tree("residual", (tp.Tree("zscore", (tp.Tree("", leaf="volume"),)), tp.Tree("", leaf="discount")))))
_cells("bh13_tree_slots", factor=lambda p: tp.compile_behaviour(p, tp.BehaviourGene("growth_crowding_risk", "crowding_interaction", {"growth_anchor": tp.Slot(_TREE), "crowding_signal": tp.Slot(tp.Tree("clip", (tp.Tree("", leaf="tax"),))), "fund_support": tp.Slot(tp.Tree("", leaf="label"))}), ("industry", "size")))

# Programs.
PROGRAMS = {
    "fp_momentum": call("cs_rank", call("sub", call("ts_mean_5", field("price")), call("ts_mean_20", field("price")))),
    "fp_gated": call("gate_zero", call("cs_zscore", field("volume")), call("mask_rank_high_50", call("ts_return_5", field("price")))),
    "fp_residual": call("cs_resid", call("slog", field("amount")), call("add", field("volume"), const(1.5))),
    "fp_corr": call("mul", call("ts_corr_20", field("price"), field("volume")), call("sign", call("ts_delta_5", field("price")))),
    "fp_decay": call("cs_winsorize_5pct", call("qdiv", call("decay_linear_20", field("price")), call("ts_std_20", field("price")))),
    "fp_deep": call("gate_nan", call("cs_demean", call("add", call("ts_zscore_20", field("price")), call("cs_rank", call("ts_max_to_min_20", field("high"))))), call("mask_rank_low_20", field("discount"))),
}
for _name, _root in PROGRAMS.items():
    _cells(_name, factor=lambda p, r=_root: compile_program(p, Program(r), mask_inputs=False))


# Feature recipes.
def _features(name: str, f: Callable[[Layers], dict[str, str]]) -> None:
    PANEL[name] = lambda p: p.select(KEYS | f(p))


_features("fe4_8_differences", lambda p: fe.differences(p, {"gap": ("high", "low"), "acceleration": ("price", ts.delay(p, "price", 4)), "quality": ("tax", "discount")}))
_features("fe6_9_rank_composite", lambda p: fe.rank_composite(p, ["price", "volume", "tax", "discount"]))
_features("fe11_12_ratios", lambda p: fe.ratios(p, {"a": ("tax", "discount"), "b": ("high", "price")}))
_features("fe10_revisions", lambda p: {"last": ts.last_revision(p, "volume"), "flag": ts.update_flag(p, "volume")})
_features("fe15_average_spreads", lambda p: fe.average_spreads(p, "price") | {"amount_crowding": fe.average_spreads(p, "volume")["to_long"]})
_features("fe16_divergence", lambda p: {"pv": fe.divergence(p, ts.pct_change(p, "price", 5), ts.pct_change(p, "volume", 5))})
_features("fe17_18_consensus", lambda p: fe.consensus(p, ["price", "volume", "tax", "discount", "size"]))
_features("fe19_20_adjusted_trend", lambda p: {"trend": fe.adjusted_trend(p, ts.pct_change(p, "price", 20), ts.drawdown(p, "price", 20)), "crowding": pw.mul(p, cs.rank_pct(p, "volume"), cs.rank_pct(p, "price"))})
_features("fe21_24_money_flow", lambda p: fe.money_flow(p, "volume", p.let("CAST(lines AS DOUBLE)")))
_features("fe25_27_book", lambda p: fe.book_measures(p, "low", "high", "volume", p.let("volume * (1 - discount)")))
_features("fe29_shocks", lambda p: fe.shocks(p, "price", "high", "low", "volume"))
_features("fe30_31_composites", lambda p: {"overheat": fe.overheat(p, ["price", "volume", "size", "tax"]), "flow_price": fe.divergence(p, ts.ts_sum(p, "volume", 5), ts.pct_change(p, "price", 5))})


def _made_up(p: Layers, names: list[str]) -> None:
    """Base columns the order tables don't have, as sums of those they have: no two alike, all with gaps where prices have them."""
    for i, n in enumerate(names):
        p.let(f"price * {0.001 * (1 + i % 7)!r} + volume * {0.01 * (1 + i % 5)!r} - discount * {1.0 + i % 11!r} + tax * {0.5 + i % 3!r} + {(i * 37) % 101!r}E-2", n)


def _recipes(p: Layers) -> dict[str, str]:
    names = [n for k in ("growth", "valuation", "structure", "operating", "cash_flow") for n in rc.CATALOGUES[k]]
    _made_up(p, [*names, "interest_bearing_debt_to_asset_ratio_ttm", "inventory_turnover_ttm_global_rank"])
    return rc.derive(p)


def _technical(p: Layers) -> dict[str, str]:
    _made_up(p, rc.TECHNICAL)
    return rc.derive(p)


def _flows(p: Layers) -> dict[str, str]:
    _made_up(p, [*[f"{side}_{s}_{unit}" for unit in ("amount", "vol") for side in ("buy", "sell") for s in rc.SIZES], "mf_net_amount"])
    return rc.money_flow(p)


def _cross(p: Layers) -> dict[str, str]:
    _flows(p)
    p.let("volume / 1000", "Turnover")
    out = rc.price_volume(p, "price", "high", "low", "amount", "volume", "Turnover")
    _made_up(p, ["ob_imbalance_5_close30_mean", "ob_net_bid_change_5_close30_mean", "ob_close_chase_pressure", "ob_liquidity_stress"])
    return out | rc.derive(p)


_features("fe4_13_recipes", _recipes)
_features("fe14_20_technical", _technical)
_features("fe21_24_flows", _flows)
_features("fe29_31_cross", _cross)

# Metrics, of the mean of five ranks.
def factor_of(p: Layers) -> str:
    return ts.ts_meanrank(p, "price", 5)


def _rounded_series(sql: str, column: str = "ic") -> str:
    return f"SELECT {DATE}, round({column}, 6) + 0.0E0 AS {column}, n FROM ({sql}) out"


def _metric(name: str, f: Callable[[Layers], tuple[str, list[str]]], wrap: Callable[[str], str] = lambda s: s) -> None:
    def build(p: Layers):
        sql, cols = f(p)
        return p.query(wrap(sql), cols)

    PANEL[name] = build


_metric("mt1_daily_ic", lambda p: mt.daily_ic(p, factor_of(p), "label"), _rounded_series)
_metric("mt2_rank_ic_joint", lambda p: mt.daily_rank_ic(p, factor_of(p), "label"), _rounded_series)
_metric("mt3_rank_ic_own", lambda p: mt.daily_rank_ic(p, factor_of(p), "label", mt.PROGRAM), _rounded_series)
_metric("mt4_5_ic_summary", lambda p: mt.daily_rank_ic(p, factor_of(p), "label"), lambda s: mt.scored(s, "rank_ic"))
_metric("mt6_coverage", lambda p: mt.coverage_sql(p, _scaled(p)[0], "label"))
_metric("mt7_ndcg", lambda p: mt.ndcg_sql(p, factor_of(p), "label", fraction=0.2))
_metric("mt8_ndcg_joint", lambda p: mt.ndcg_sql(p, factor_of(p), "label", k=5, bins=5, own_bins=False))
_metric("mt9_turnover", lambda p: mt.turnover_sql(p, factor_of(p), fraction=0.2))
_metric("mt10_stability", lambda p: mt.stability_sql(p, factor_of(p)))
_metric("mt11_long_side", lambda p: mt.long_side(p, factor_of(p), "label"), lambda s: mt.scored(s, "rank_ic"))
_metric("mt12_ic_summary", lambda p: mt.daily_ic(p, factor_of(p), "label"), lambda s: mt.scored(s, "ic_mean"))
_metric("mt13_residual_rank_ic", lambda p: mt.daily_rank_ic(p, tp.neutralise(p, factor_of(p), ("industry", "size")), "label"), lambda s: mt.scored(s, "rank_ic"))
_metric("mt14_program_score", lambda p: mt.daily_rank_ic(p, compile_program(p, Program(PROGRAMS["fp_momentum"])), "label", mt.PROGRAM), lambda s: mt.scored(s, "rank_ic"))
_metric("mt17_windows", lambda p: (f"""WITH d AS (SELECT {DATE}, row_number() OVER (ORDER BY {DATE}) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {DATE} FROM {{panel}}) q)
  SELECT CAST((i - 105) / 26 AS BIGINT) AS w, {DATE} AS test_start, i - 5 AS train_end FROM d WHERE i >= 105 AND (i - 105) % 26 = 0 AND i + 25 <= n""", ["price"]))

# Portfolios.
_metric("pl12_top_set", lambda p: pl.top_set_return(p, factor_of(p), "label"))
_metric("mt19_comparison", lambda p: cmp.comparison_sql(p, p.let("label * 100"), p.let("CASE WHEN volume > 10 THEN label * 101 + discount END")))

# The whole bundle of metrics in one plan.
_metric("mt12_bundle", lambda p: sc.bundle_sql(p, factor_of(p), "label"))
_metric("mt13_bundle_neutral", lambda p: sc.bundle_sql(p, factor_of(p), "label", sc.ScorerConfig(steps=("size", "industry"))))
_metric("mt14_bundle_program", lambda p: sc.bundle_sql(p, compile_program(p, Program(PROGRAMS["fp_momentum"])), "label", sc.ScorerConfig(mt.PROGRAM, 5, bins=5, own_bins=False, direction=-1)))


def _six(*columns: str) -> str:
    return ", ".join(f"round({c} + 1.3E-10, 6) + 0.0E0 AS {c}" for c in columns)


_metric("pl1_5_group_returns", lambda p: pl.group_returns(p, factor_of(p), "label"), lambda s: f"SELECT {DATE}, g, members, {_six('gross', 'turnover', 'net')} FROM ({s}) out")
_metric("pl6_7_long_short", lambda p: pl.long_short(p, factor_of(p), "label"), lambda s: f"SELECT {DATE}, {_six('long_ret', 'short_ret', 'ls_ret', 'benchmark', 'long_turnover')} FROM ({s}) out")
_metric("pl8_11_performance", lambda p: pl.performance(p, factor_of(p), "label"))

# Summaries.
_metric("ag2_column_profile", lambda p: (" UNION ALL ".join(f"SELECT '{c}' AS name, round(count({c}) * 1.0E0 / count(*), 6) AS coverage, round(sum(CASE WHEN {c} > 0 THEN 1.0E0 ELSE 0.0E0 END) / count({c}), 6) AS positive, round(sum(CASE WHEN {c} = 0 THEN 1.0E0 ELSE 0.0E0 END) / count({c}), 6) AS zero, count(DISTINCT {c}) AS uniques FROM {{panel}}" for c in ("price", "volume", "discount", "label")), ["price", "volume", "discount", "label"]))
_metric("ag14_panel_summary", lambda p: (f"SELECT min({DATE}) AS first_date, max({DATE}) AS last_date, count(DISTINCT {DATE}) AS dates, count(DISTINCT {NAME}) AS contracts, count(*) AS cells, CAST(sum(CASE WHEN tradeable THEN 1 ELSE 0 END) AS BIGINT) AS tradeable FROM {{panel}}", ["price"]))
_metric("ag11_yearly_mean", lambda p: (f"SELECT CAST(extract(year FROM {DATE}) AS INT) AS year, industry, round(avg(label), 6) + 0.0E0 AS label FROM {{panel}} WHERE tradeable GROUP BY CAST(extract(year FROM {DATE}) AS INT), industry", ["label"]))


def tables(spark: SparkSession, sf_dir: str) -> None:
    for t in ("orders", "customer", "events", "part", "lineitem", "supplier", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def on_spark(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        tables(spark, sf_dir)
        return build(weekly_panel(spark, sf_dir))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quillon import library_queries, table_queries

    return {k: on_spark(f) for k, f in PANEL.items()} | table_queries.queries() | library_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from quillon import library_queries, table_queries

    return {k: f(weekly_text()) for k, f in PANEL.items()} | table_queries.oracle_sql() | library_queries.ORACLES


OPERATOR_NAMES = tuple(OPERATORS)
