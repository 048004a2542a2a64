"""The feature recipes by name: catalogues of base columns, and what is derived from them.

A recipe is an SQL expression over columns, or a few lines over column functions. ``derive`` adds those whose columns the
panel has, so that a table without some family of columns simply lacks what is derived from it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import cross_section as cs
from quillon.functions import pointwise as pw
from quillon.functions import time_series as ts
from quillon.plans.layers import Layers

# Base columns by catalogue.
GROWTH = (
    "inc_revenue_lyr inc_revenue_ttm inc_return_on_equity_lyr inc_return_on_equity_ttm inc_book_per_share_lyr inc_book_per_share_ttm inc_book_per_share_lf operating_profit_growth_ratio_lyr "
    "operating_profit_growth_ratio_ttm net_profit_growth_ratio_lyr net_profit_growth_ratio_ttm profit_growth_ratio_lyr profit_growth_ratio_ttm gross_profit_growth_ratio_lyr gross_profit_growth_ratio_ttm "
    "operating_revenue_growth_ratio_lyr operating_revenue_growth_ratio_ttm net_asset_growth_lyr net_asset_growth_ratio_ttm net_asset_growth_ratio_lf total_asset_growth_ratio_lyr total_asset_growth_ratio_ttm "
    "total_asset_growth_ratio_lf net_profit_parent_company_growth_ratio_lyr net_profit_parent_company_growth_ratio_ttm net_cash_flow_growth_lyr net_cash_flow_growth_ratio_ttm "
    "net_operate_cash_flow_growth_ratio_lyr net_operate_cash_flow_growth_ratio_ttm net_investing_cash_flow_growth_ratio_lyr net_investing_cash_flow_growth_ratio_ttm "
    "net_financing_cash_flow_growth_ratio_lyr net_financing_cash_flow_growth_ratio_ttm"
).split()
VALUATION = (
    "ep_ratio_lyr ep_ratio_ttm cfp_ratio_lyr cfp_ratio_ttm book_to_market_ratio_lyr book_to_market_ratio_ttm book_to_market_ratio_lf dividend_yield_ttm dividend_yield_lyr peg_ratio_lyr peg_ratio_ttm "
    "sp_ratio_lyr sp_ratio_ttm market_cap a_share_market_val a_share_market_val_in_circulation ev_lyr ev_lf ev_ttm ev_no_cash_lyr ev_no_cash_ttm ev_no_cash_lf ev_to_ebitda_lyr ev_to_ebitda_ttm "
    "ev_no_cash_to_ebit_lyr ev_no_cash_to_ebit_ttm"
).split()
STRUCTURE = (
    "debt_to_asset_ratio_ttm debt_to_asset_ratio_lyr debt_to_asset_ratio_lf equity_multiplier_ttm equity_multiplier_lyr equity_multiplier_lf capital_to_equity_ratio_ttm capital_to_equity_ratio_lf "
    "debt_to_equity_ratio_ttm debt_to_equity_ratio_lf book_leverage_ttm market_leverage_ttm interest_bearing_debt_ttm interest_bearing_debt_lf interest_bearing_debt_to_capital_ttm "
    "interest_bearing_debt_to_capital_lf net_debt_ttm net_debt_lf current_debt_to_total_debt_ttm current_debt_to_total_debt_lf non_current_debt_to_total_debt_ttm non_current_debt_to_total_debt_lf "
    "current_ratio_ttm current_ratio_lf quick_ratio_ttm quick_ratio_lf super_quick_ratio_ttm super_quick_ratio_lf cash_ratio_ttm cash_ratio_lf current_asset_to_total_asset_lf "
    "current_asset_to_total_asset_ttm non_current_asset_to_total_asset_ttm non_current_asset_to_total_asset_lf fixed_asset_ratio_ttm fixed_asset_ratio_lf intangible_asset_ratio_ttm "
    "intangible_asset_ratio_lf equity_fixed_asset_ratio_ttm equity_fixed_asset_ratio_lf working_capital_ttm working_capital_lf net_working_capital_ttm net_working_capital_lf "
    "long_term_debt_to_working_capital_ttm long_term_debt_to_working_capital_lf book_value_per_share_ttm book_value_per_share_lf retained_earnings_per_share_ttm retained_earnings_per_share_lf "
    "undistributed_profit_per_share_ttm undistributed_profit_per_share_lf tangible_asset_per_share_ttm tangible_asset_per_share_lf cash_equivalent_per_share_ttm cash_equivalent_per_share_lf "
    "liabilities_per_share_ttm liabilities_per_share_lf"
).split()
OPERATING = (
    "diluted_earnings_per_share_ttm adjusted_earnings_per_share_ttm adjusted_fully_diluted_earnings_per_share_ttm operating_total_revenue_per_share_ttm operating_revenue_per_share_ttm ebit_per_share_ttm "
    "return_on_equity_ttm return_on_equity_diluted_ttm adjusted_return_on_equity_ttm adjusted_return_on_equity_diluted_ttm return_on_asset_ttm return_on_asset_net_profit_ttm return_on_invested_capital_ttm "
    "net_profit_margin_ttm gross_profit_margin_ttm cost_to_sales_ttm net_profit_to_revenue_ttm profit_from_operation_to_revenue_ttm ebit_to_revenue_ttm expense_to_revenue_ttm "
    "operating_profit_to_profit_before_tax_ttm investment_profit_to_profit_before_tax_ttm non_operating_profit_to_profit_before_tax_ttm income_tax_to_profit_before_tax_ttm "
    "adjusted_profit_to_total_profit_ttm ebitda_to_debt_ttm time_interest_earned_ratio_ttm account_payable_turnover_rate_ttm account_payable_turnover_days_ttm account_receivable_turnover_rate_ttm "
    "account_receivable_turnover_days_ttm inventory_turnover_ttm current_asset_turnover_ttm fixed_asset_turnover_ttm total_asset_turnover_ttm equity_turnover_ratio_ttm operating_cycle_ttm "
    "average_payment_period_ttm cash_conversion_cycle_ttm du_profit_margin_ttm du_return_on_equity_ttm du_return_on_sales_ttm income_from_main_operations_ttm"
).split()
CASH_FLOW = (
    "cash_flow_per_share_ttm operating_cash_flow_per_share_ttm free_cash_flow_company_per_share_ttm free_cash_flow_equity_per_share_ttm fcff_ttm fcfe_ttm ocf_to_debt_ttm "
    "surplus_cash_protection_multiples_ttm ocf_to_interest_bearing_debt_ttm ocf_to_current_ratio_ttm ocf_to_net_debt_ttm depreciation_and_amortization_lyr"
).split()


def _windows(names: str, sizes: str) -> list[str]:
    return [f"{n}{w}" for n in names.split() for w in sizes.split()]


TECHNICAL = [
    *"MACD_DIFF MACD_DEA MACD_HIST TRIX MATRIX DPO MADPO DKX MADKX BOLL BOLL_UP BOLL_DOWN BBI BBIBOLL_UP BBIBOLL_DOWN BIAS5 BIAS10 BIAS20 BIAS36 BIAS612 MABIAS".split(),
    *_windows("MA EMA WMA", "5 10 20 60 120 250"),
    *"RSI6 RSI10 MARSI6 MARSI10 KDJ_K KDJ_D KDJ_J SKD_K SKD_D WR LWR1 LWR2 CCI ROC OSC MTM MAMTM TR ATR MDD20 MDD60 AMP1 AMP3 AMP5 AMP10 AMP20 AMP60 MASS MAMASS".split(),
    *_windows("VOL", "5 10 20 60 120 250"), "DAVOL5", "DAVOL10", "DAVOL20", *_windows("VMA AMV", "5 10 20 60 120 250"),
    *"TAPI MATAPI OBV MFI VR MAVR DI1 DI2 ADX ADXR AROON_UP AROON_DOWN AR BR CR MACR1 MACR2 MACR3 MACR4 CYF CYR MACYR PCNT SY SWL SWS ADTM MAADTM ASI ASIT ACCER MCST UDL MAUDL VOLT20 VOLT60 QTYR_5_20".split(),
]
CATALOGUES = {"growth": GROWTH, "valuation": VALUATION, "structure": STRUCTURE, "operating": OPERATING, "cash_flow": CASH_FLOW, "technical": TECHNICAL}

# Derived columns as plain sums, differences and products of columns.
SUMS = {
    "valuation": {
        "ep_revaluation": "ep_ratio_ttm - ep_ratio_lyr", "cfp_revaluation": "cfp_ratio_ttm - cfp_ratio_lyr", "bm_revaluation": "book_to_market_ratio_ttm - book_to_market_ratio_lyr",
        "sp_revaluation": "sp_ratio_ttm - sp_ratio_lyr", "ev_ebitda_revaluation": "ev_to_ebitda_ttm - ev_to_ebitda_lyr",
        "cashflow_vs_earnings_yield_gap": "cfp_ratio_ttm - ep_ratio_ttm", "book_vs_earnings_yield_gap": "book_to_market_ratio_ttm - ep_ratio_ttm",
        "sales_vs_earnings_yield_gap": "sp_ratio_ttm - ep_ratio_ttm", "dividend_vs_earnings_yield_gap": "dividend_yield_ttm - ep_ratio_ttm",
        "ev_no_cash_discount_ttm": "ev_no_cash_ttm - ev_ttm", "ev_no_cash_discount_lf": "ev_no_cash_lf - ev_lf", "ev_cash_adjustment_gap": "ev_no_cash_to_ebit_ttm - ev_to_ebitda_ttm",
    },
    "growth": {
        "rev_growth_accel": "operating_revenue_growth_ratio_ttm - operating_revenue_growth_ratio_lyr", "gross_profit_growth_accel": "gross_profit_growth_ratio_ttm - gross_profit_growth_ratio_lyr",
        "oper_profit_growth_accel": "operating_profit_growth_ratio_ttm - operating_profit_growth_ratio_lyr", "net_profit_growth_accel": "net_profit_growth_ratio_ttm - net_profit_growth_ratio_lyr",
        "parent_profit_growth_accel": "net_profit_parent_company_growth_ratio_ttm - net_profit_parent_company_growth_ratio_lyr",
        "oper_cash_growth_accel": "net_operate_cash_flow_growth_ratio_ttm - net_operate_cash_flow_growth_ratio_lyr",
        "gross_vs_revenue_growth_gap": "gross_profit_growth_ratio_ttm - operating_revenue_growth_ratio_ttm", "oper_vs_revenue_growth_gap": "operating_profit_growth_ratio_ttm - operating_revenue_growth_ratio_ttm",
        "net_vs_oper_growth_gap": "net_profit_growth_ratio_ttm - operating_profit_growth_ratio_ttm", "parent_vs_gross_growth_gap": "net_profit_parent_company_growth_ratio_ttm - gross_profit_growth_ratio_ttm",
        "oper_vs_net_profit_growth_gap": "operating_profit_growth_ratio_ttm - net_profit_growth_ratio_ttm",
        "parent_vs_net_profit_growth_gap": "net_profit_parent_company_growth_ratio_ttm - net_profit_growth_ratio_ttm",
        "ocf_vs_net_profit_growth_gap": "net_operate_cash_flow_growth_ratio_ttm - net_profit_growth_ratio_ttm",
        "ocf_vs_oper_profit_growth_gap": "net_operate_cash_flow_growth_ratio_ttm - operating_profit_growth_ratio_ttm",
        "ocf_vs_revenue_growth_gap": "net_cash_flow_growth_ratio_ttm - operating_revenue_growth_ratio_ttm",
        "asset_rev_growth_efficiency": "operating_revenue_growth_ratio_ttm - total_asset_growth_ratio_ttm", "asset_profit_growth_efficiency": "net_profit_growth_ratio_ttm - total_asset_growth_ratio_ttm",
        "asset_operate_cash_efficiency": "net_operate_cash_flow_growth_ratio_ttm - total_asset_growth_ratio_ttm",
        "financing_vs_ocf_growth_gap": "net_financing_cash_flow_growth_ratio_ttm - net_operate_cash_flow_growth_ratio_ttm",
        "financing_vs_profit_growth_gap": "net_financing_cash_flow_growth_ratio_ttm - net_profit_growth_ratio_ttm", "asset_vs_net_asset_growth_gap": "total_asset_growth_ratio_ttm - net_asset_growth_ratio_ttm",
    },
    "structure": {
        "leverage_change": "debt_to_asset_ratio_ttm - debt_to_asset_ratio_lyr", "equity_multiplier_change": "equity_multiplier_ttm - equity_multiplier_lyr",
        "interest_debt_pressure": "interest_bearing_debt_to_capital_ttm + interest_bearing_debt_to_asset_ratio_ttm", "short_debt_bufferr": "current_debt_to_total_debt_ttm - quick_ratio_ttm",
        "liquidity_bufferr": "quick_ratio_ttm + super_quick_ratio_ttm - cash_ratio_ttm - current_debt_to_total_debt_ttm",
    },
    "operating": {
        "roe_leverage_adjusted": "return_on_equity_ttm - equity_multiplier_ttm", "adjusted_roe_gap": "adjusted_return_on_equity_ttm - return_on_equity_ttm",
        "roic_vs_roa_gap": "return_on_invested_capital_ttm - return_on_asset_ttm", "margin_quality_spread": "gross_profit_margin_ttm - net_profit_margin_ttm",
        "operating_margin_quality": "profit_from_operation_to_revenue_ttm - net_profit_to_revenue_ttm", "expense_pressure": "expense_to_revenue_ttm + cost_to_sales_ttm",
        "non_operating_profit_pressure": "non_operating_profit_to_profit_before_tax_ttm + investment_profit_to_profit_before_tax_ttm",
        "core_profit_quality": "operating_profit_to_profit_before_tax_ttm - non_operating_profit_to_profit_before_tax_ttm",
        "turnover_efficiency_score": "account_receivable_turnover_rate_ttm + inventory_turnover_ttm + total_asset_turnover_ttm",
        "working_capital_cycle_pressure": "account_receivable_turnover_days_ttm + inventory_turnover_ttm_global_rank + cash_conversion_cycle_ttm",
    },
    "cash_flow": {
        "ocf_per_share_vs_eps": "operating_cash_flow_per_share_ttm - diluted_earnings_per_share_ttm", "fcff_vs_ocf_gap": "fcff_ttm - operating_cash_flow_per_share_ttm",
        "fcfe_vs_ocf_gap": "fcfe_ttm - operating_cash_flow_per_share_ttm", "cashflow_debt_coverage": "ocf_to_debt_ttm + ocf_to_interest_bearing_debt_ttm + ocf_to_net_debt_ttm",
        "cashflow_short_debt_buffer": "ocf_to_current_ratio_ttm + quick_ratio_ttm - current_debt_to_total_debt_ttm",
        "free_cashflow_quality": "free_cash_flow_company_per_share_ttm + free_cash_flow_equity_per_share_ttm - cash_flow_per_share_ttm",
        "cashflow_interest_safety": "ocf_to_interest_bearing_debt_ttm + time_interest_earned_ratio_ttm",
    },
}
# Ratios of columns, missing where the second is next to zero; of some, less one or over the second's size.
RATIOS = {
    "structure": {"net_debt_to_book": ("net_debt_ttm", "book_value_per_share_ttm"), "cash_eq_to_share_support": ("cash_equivalent_per_share_ttm", "liabilities_per_share_ttm"), "retained_earnings_support": ("retained_earnings_per_share_ttm", "book_value_per_share_ttm")},
    "technical_spread": {
        "ma_5_20_spread": ("MA5", "MA20"), "ma_20_60_spread": ("MA20", "MA60"), "ma_60_120_spread": ("MA60", "MA120"), "ema_5_20_spread": ("EMA5", "EMA20"), "ema_20_60_spread": ("EMA20", "EMA60"),
        "volume_crowding_5_20": ("VOL5", "VOL20"), "volume_crowding_5_60": ("VOL5", "VOL60"), "volume_crowding_20_120": ("VOL20", "VOL120"), "amount_crowding_5_20": ("AMV5", "AMV20"), "amount_crowding_20_60": ("AMV20", "AMV60"),
    },
    "technical_size": {"trend_vol_adjusted_20": ("ma_5_20_spread", "ATR"), "momentum_drawdown_adjusted": ("ROC", "MDD20"), "momentum_wave_adjusted": ("ROC", "MDD20"), "macd_vol_adjusted": ("MACD_HIST", "ATR")},
}
PLAIN_RATIOS = {"asset_liability_structure": ("current_asset_to_total_asset_ttm", "fixed_asset_ratio_ttm"), "intangible_leverage_pressure": ("intangible_asset_ratio_ttm", "total_asset_turnover_ttm")}
VALUE_RANKED = ("ep_ratio_ttm", "cfp_ratio_ttm", "book_to_market_ratio_ttm", "sp_ratio_ttm", "dividend_yield_ttm")
GROWTH_BALANCED = ("operating_revenue_growth_ratio_ttm", "gross_profit_growth_ratio_ttm", "operating_profit_growth_ratio_ttm", "net_profit_growth_ratio_ttm", "net_operate_cash_flow_growth_ratio_ttm", "inc_return_on_equity_ttm")
REVISED = {"operating_profit_growth_last_revision": "operating_profit_growth_ratio_lyr", "net_profit_growth_last_revision": "net_profit_growth_ratio_lyr", "parent_profit_last_revision": "net_profit_parent_company_growth_ratio_lyr", "operate_cash_last_revision": "net_operate_cash_flow_growth_ratio_lyr"}
UPDATED = {"operating_profit_growth_update_flag": "operating_profit_growth_ratio_lyr", "net_profit_growth_update_flag": "net_profit_growth_ratio_lyr", "oper_cash_growth_update_flag": "net_operate_cash_flow_growth_ratio_lyr"}
REVERSAL = ("RSI6", "RSI10", "KDJ_K", "KDJ_D", "KDJ_J", "WR", "CCI", "BIAS5", "BIAS20")
TREND = ("MACD_DIFF", "MACD_HIST", "TRIX", "ROC", "ma_5_20_spread", "ma_20_60_spread")
# Products and differences of rank percentages; |x| ranks a column's size.
RANKED = {
    "price_volume_divergence_5_20": "rank(ma_5_20_spread) - rank(volume_crowding_5_20)", "price_volume_divergence_20_60": "rank(ma_20_60_spread) - rank(volume_crowding_20_120)",
    "obv_price_divergence_20_60": "rank(OBV) - rank(ma_20_60_spread)", "mfi_rsi_divergence": "rank(MFI) - rank(RSI10)",
    "crowded_momentum_risk": "rank(ma_5_20_spread) * rank(volume_crowding_5_20) * rank(RSI6)", "crowded_overbought_risk": "overbought_consensus * rank(volume_crowding_5_20)",
    "panic_oversold_score": "rank(|MDD20|) * rank(|ATR|) * (1 - overbought_consensus)", "downside_volume_panic": "rank(|MDD20|) * rank(volume_crowding_5_20)",
    "trend_strength_confirmed": "rank(ADX) * rank(ma_20_60_spread)", "aroon_direction_gap": "AROON_UP - AROON_DOWN", "aroon_trend_confirmed": "rank(aroon_direction_gap) * rank(ADX)",
}
# Composites across modules, of rank percentages less a half.
CROSS = {
    "flow_price_divergence_5d": "rank(mf_net_amount_ratio_5d) - rank(ret_5d)", "institution_accumulation": "rank(mf_large_net_ratio_5d) - rank(ret_5d)",
    "retail_chase_risk": "rank(ret_5d) + rank(mf_sm_net_ratio_5d) - rank(mf_large_net_ratio_5d)", "large_order_confirmed_momentum": "rank(ret_20d) * rank(mf_large_net_ratio_20d)",
    "moneyflow_crowding_risk": "rank(ret_20d) + rank(turnover_shock_5_20) + rank(mf_large_net_ratio_20d)",
    "orderbook_panic_reversal": "rank(-ret_5d) + rank(ob_imbalance_5_close30_mean) + rank(ob_net_bid_change_5_close30_mean)",
    "orderbook_chase_risk": "rank(ret_5d) + rank(ob_close_chase_pressure) + rank(mf_sm_net_ratio_5d)", "liquidity_neglect": "rank(ob_liquidity_stress) - rank(turnover_shock_5_20)",
}
SIZES = ("sm", "md", "lg", "elg")


def _has(p: Layers, names: Iterable[str]) -> bool:
    return all(n in p.depth for n in names)


def _words(expression: str) -> list[str]:
    return [w for w in re.findall(r"[A-Za-z_]\w*", expression) if w != "rank"]


def _ranked(p: Layers, expression: str, rank: Callable[[Layers, str], str]) -> str:
    """An expression in which rank(x), rank(-x) and rank(|x|) stand for rank columns."""

    def one(m: re.Match) -> str:
        x = m[1]
        column = pw.absolute(p, x[1:-1]) if x[0] == "|" else pw.neg(p, x[1:]) if x[0] == "-" else x
        return rank(p, column)

    return re.sub(r"rank\(([^()]+)\)", one, expression)


def derive(p: Layers) -> dict[str, str]:
    """Add every recipe whose columns are there; derived columns by name."""
    out: dict[str, str] = {}

    def add(name: str, expression: str, needs: Iterable[str]) -> None:
        if _has(p, needs):
            out[name] = p.let(expression, name)

    for table in SUMS.values():
        for name, e in table.items():
            add(name, e, _words(e))
    for family, table in RATIOS.items():
        for name, (a, b) in table.items():
            if _has(p, (a, b)):
                r = pw.divide(p, a, pw.absolute(p, b) if family == "technical_size" else b, pw.RECIPE_EPS)
                add(name, f"{r} - 1" if family == "technical_spread" else f"{r} + 0", ())
    for name, (a, b) in PLAIN_RATIOS.items():
        if _has(p, (a, b)):
            add(name, f"{pw.divide_nonzero(p, a, b)} + 0", ())
    if _has(p, VALUE_RANKED):
        r = [cs.rank_pct(p, c) for c in VALUE_RANKED]
        for name, c in (("value_composite_rank", pw.row_mean(p, r)), ("deep_value_score", pw.row_min(p, r)), ("valuation_dispersion", pw.row_std(p, r)), ("valuation_consensus", pw.row_count_above(p, r, 0.7))):
            add(name, f"{c} + 0", ())
    if _has(p, GROWTH_BALANCED):
        r, g = [cs.rank_pct(p, c) for c in GROWTH_BALANCED], list(GROWTH_BALANCED)
        for name, c in (
            ("balanced_growth_mean", pw.row_mean(p, g)), ("balanced_growth_min", pw.row_min(p, g)), ("growth_dispersion", pw.row_std(p, g)), ("growth_positive_count", pw.row_count_above(p, g, 0)),
            ("balanced_growth_rank_mean", pw.row_mean(p, r)), ("balanced_growth_rank_min", pw.row_min(p, r)), ("balanced_growth_rank_dispersion", pw.row_std(p, r)),
        ):
            add(name, f"{c} + 0", ())
    for names, f in ((REVISED, ts.last_revision), (UPDATED, ts.update_flag)):
        for name, c in names.items():
            if _has(p, (c,)):
                add(name, f"{f(p, c)} + 0", ())
    if _has(p, REVERSAL):
        r = [cs.rank_pct(p, c) for c in REVERSAL]
        below = " + ".join(f"CASE WHEN {x} < 0.2 THEN 1 ELSE 0 END" for x in r)
        for name, c in (("overbought_consensus", pw.row_mean(p, r)), ("overbought_extreme_count", pw.row_count_above(p, r, 0.8)), ("oversold_extreme_count", p.let(f"CAST({below} AS DOUBLE)")), ("reversal_signal_dispersion", pw.row_std(p, r))):
            add(name, f"{c} + 0", ())
    if _has(p, TREND):
        r = [cs.rank_pct(p, c) for c in TREND]
        for name, c in (("trend_consensus", pw.row_mean(p, r)), ("trend_extreme_count", pw.row_count_above(p, r, 0.8)), ("trend_dispersion", pw.row_std(p, r))):
            add(name, f"{c} + 0", ())
    for table, rank in ((RANKED, cs.rank_pct), (CROSS, cs.centred_rank)):
        for name, e in table.items():
            if _has(p, _words(e)):
                add(name, _ranked(p, e, rank), ())
    return out


def money_flow(p: Layers) -> dict[str, str]:
    """Nets, totals, ratios, participation, imbalance and rolling sums by contract, of buy_/sell_ columns of four order sizes and mf_net_amount."""
    out: dict[str, str] = {}

    def add(name: str, expression: str) -> str:
        out[name] = p.let(expression, name)
        return name

    over = lambda name, a, b: add(name, f"{pw.divide_nonzero(p, p.let(a), p.let(b))} + 0")
    for unit in ("amount", "vol"):
        for s in SIZES:
            add(f"mf_net_{s}_{unit}", f"buy_{s}_{unit} - sell_{s}_{unit}")
    buy = add("mf_buy_amount_total", " + ".join(f"buy_{s}_amount" for s in SIZES))
    sell = add("mf_sell_amount_total", " + ".join(f"sell_{s}_amount" for s in SIZES))
    total = add("mf_trade_amount_total", f"{buy} + {sell}")
    over("mf_net_amount_ratio", "mf_net_amount + 0", f"{total} + 0")
    for s in SIZES:
        over(f"mf_{s}_net_ratio", f"mf_net_{s}_amount + 0", f"{total} + 0")
        over(f"mf_{s}_s1", f"mf_net_{s}_amount + 0", f"{total} + 0")
        over(f"mf_{s}_s2", f"mf_net_{s}_amount + 0", f"buy_{s}_amount + 0")
        over(f"mf_{s}_s3", f"mf_net_{s}_amount + 0", f"abs(mf_net_{s}_amount)")
    over("mf_large_net_ratio", "mf_net_lg_amount + mf_net_elg_amount", f"{total} + 0")
    over("mf_md_large_net_ratio", "mf_net_md_amount + mf_net_lg_amount + mf_net_elg_amount", f"{total} + 0")
    add("mf_large_vs_small_net", "mf_large_net_ratio - mf_sm_net_ratio")
    over("mf_active_buy_ratio", f"{buy} + 0", f"{total} + 0")
    over("mf_active_sell_ratio", f"{sell} + 0", f"{total} + 0")
    over("mf_active_imbalance", f"{buy} + 0", f"{sell} + 0")
    over("mf_large_participation", "buy_lg_amount + sell_lg_amount + buy_elg_amount + sell_elg_amount", f"{total} + 0")
    over("mf_small_participation", "buy_sm_amount + sell_sm_amount", f"{total} + 0")
    large = p.let("mf_net_lg_amount + mf_net_elg_amount")
    positive = p.let("CASE WHEN mf_large_net_ratio > 0 THEN 1.0E0 ELSE 0.0E0 END")
    for w in (5, 20):
        whole = lambda x: ts.ts_sum(p, x, w, w)  # noqa: E731, B023
        for name, x in (("mf_net_amount_ratio", "mf_net_amount"), ("mf_large_net_ratio", large), ("mf_sm_net_ratio", "mf_net_sm_amount")):
            add(f"{name}_{w}d", f"{pw.divide_nonzero(p, whole(x), whole(total))} + 0")
        add(f"mf_large_vs_small_net_{w}d", f"mf_large_net_ratio_{w}d - mf_sm_net_ratio_{w}d")
        add(f"mf_large_positive_days_{w}d", f"{ts.ts_mean(p, positive, w)} + 0")
        add(f"mf_active_imbalance_std_{w}d", f"{ts.ts_std(p, 'mf_active_imbalance', w)} + 0")
    return out


def price_volume(p: Layers, close: str = "Close", high: str = "High", low: str = "Low", amount: str = "Amount", volume: str = "Volume", turnover: str = "Turnover") -> dict[str, str]:
    """Returns over 1, 5 and 20 rows, shocks of 5 against 20, range and its deviation, and the overheating they show together."""
    out: dict[str, str] = {}

    def add(name: str, expression: str) -> str:
        out[name] = p.let(expression, name)
        return name

    for w in (1, 5, 20):
        add(f"ret_{w}d", f"{ts.pct_change(p, close, w)} + 0")
    for name, x in (("amount", amount), ("volume", volume), ("turnover", turnover)):
        add(f"{name}_shock_5_20", f"{pw.divide_nonzero(p, ts.ts_mean(p, x, 5, 2), ts.ts_mean(p, x, 20, 6))} - 1")
    add("intraday_range", f"{pw.divide_nonzero(p, pw.sub(p, high, low), close)} + 0")
    add("range_std_20d", f"{ts.ts_std(p, 'intraday_range', 20, 6)} + 0")
    parts = ("amount_shock_5_20", "volume_shock_5_20", pw.absolute(p, "ret_1d"), "turnover_shock_5_20")
    add("short_term_overheat", " + ".join(cs.zscore(p, x, eps=1e-12) for x in parts))
    return out


def global_rank_pct(df: DataFrame, column: str, into: str | None = None, buckets: int = 256) -> DataFrame:
    """The table with a column's rank percentage among all rows of all dates, ties at their average, missing where it is.

    Distinct values go to buckets between approximate quantiles; a bucket's rows before it come from its counts, places
    within it from one window per bucket, so no task sees more than a bucket of distinct values.
    """
    into = into or f"{column}_global_rank"
    counts = df.where(F.col(column).isNotNull() & ~F.isnan(column)).groupBy(F.col(column).alias("_x")).agg(F.count("*").alias("_n"))
    cuts = sorted(set(df.approxQuantile(column, [k / buckets for k in range(1, buckets)], 0.001)))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("_x"))) if cuts else F.lit(0)
    counts = counts.withColumn("_b", bucket)
    before = counts.groupBy("_b").agg(F.sum("_n").alias("_in")).withColumn("_before", F.sum("_in").over(Window.orderBy("_b")) - F.col("_in"))  # one row a bucket
    total = before.agg(F.sum("_in").alias("_all"))
    here = F.sum("_n").over(Window.partitionBy("_b").orderBy("_x")) - F.col("_n")
    ranks = counts.withColumn("_here", here).join(before, "_b").crossJoin(total).select("_x", ((F.col("_before") + F.col("_here") + (F.col("_n") + 1) / 2) / F.col("_all")).alias(into))
    return df.join(ranks, df[column] == ranks["_x"], "left").drop("_x")


def registry() -> dict[str, tuple[str, ...]]:
    """Names of derived columns by family, for whoever asks what the recipes make."""
    book = ("ob_open_buy_intent", "ob_close_chase_pressure", "ob_liquidity_stress", "ob_close_buying_vs_day")
    return {
        **{k: tuple(v) for k, v in SUMS.items()}, "ratios": tuple(n for t in RATIOS.values() for n in t) + tuple(PLAIN_RATIOS), "revisions": (*REVISED, *UPDATED), "ranked": tuple(RANKED),
        "consensus": ("value_composite_rank", "deep_value_score", "valuation_dispersion", "valuation_consensus", "overbought_consensus", "overbought_extreme_count", "oversold_extreme_count", "reversal_signal_dispersion", "trend_consensus", "trend_extreme_count", "trend_dispersion"),
        "cross": tuple(CROSS), "orderbook": book, "price_volume": ("ret_1d", "ret_5d", "ret_20d", "amount_shock_5_20", "volume_shock_5_20", "turnover_shock_5_20", "intraday_range", "range_std_20d", "short_term_overheat"),
    }
