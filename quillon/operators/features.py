"""Derived features: recipes over named fields, each a few columns of a layered plan."""

from __future__ import annotations

from collections.abc import Mapping

from quillon.functions import cross_section as cs
from quillon.functions import pointwise as pw
from quillon.functions import time_series as ts
from quillon.plans.layers import Layers


def differences(p: Layers, pairs: Mapping[str, tuple[str, str]]) -> dict[str, str]:
    """Revaluation, acceleration, mismatch and gap features: a - b by name."""
    return {k: pw.sub(p, a, b) for k, (a, b) in pairs.items()}


def ratios(p: Layers, pairs: Mapping[str, tuple[str, str]], eps: float = pw.RECIPE_EPS) -> dict[str, str]:
    """a / b by name, missing where |b| <= eps."""
    return {k: pw.divide(p, a, b, eps) for k, (a, b) in pairs.items()}


def rank_composite(p: Layers, fields: list[str], strong: float = 0.7) -> dict[str, str]:
    """Mean, minimum, dispersion and number above ``strong`` of the fields' rank percentages."""
    r = [cs.rank_pct(p, f) for f in fields]
    return {"composite": pw.row_mean(p, r), "deep": pw.row_min(p, r), "dispersion": pw.row_std(p, r), "consensus": pw.row_count_above(p, r, strong)}


def consensus(p: Layers, fields: list[str], high: float = 0.8, low: float = 0.2) -> dict[str, str]:
    """Overbought and oversold consensus of ranks."""
    r = [cs.rank_pct(p, f) for f in fields]
    below = p.let("CAST(" + " + ".join(f"CASE WHEN {x} < {low} THEN 1 ELSE 0 END" for x in r) + " AS DOUBLE)")
    return {"mean_rank": pw.row_mean(p, r), "over": pw.row_count_above(p, r, high), "under": below, "spread": pw.row_std(p, r)}


def average_spreads(p: Layers, x: str, short: int = 5, long: int = 20) -> dict[str, str]:
    """Price over its averages less one, and the short average over the long one less one."""
    a, b = ts.ts_mean(p, x, short, 2), ts.ts_mean(p, x, long, 2)
    one = lambda u, v: p.let(f"{pw.divide(p, u, v, pw.RECIPE_EPS)} - 1")
    return {"to_short": one(x, a), "to_long": one(x, b), "short_to_long": one(a, b)}


def divergence(p: Layers, x: str, y: str) -> str:
    """Difference of rank percentages."""
    return pw.sub(p, cs.rank_pct(p, x), cs.rank_pct(p, y))


def adjusted_trend(p: Layers, trend: str, risk: str) -> str:
    """Trend over |risk|."""
    return pw.divide(p, trend, pw.absolute(p, risk), pw.RECIPE_EPS)


def money_flow(p: Layers, buy: str, sell: str, window: int = 20) -> dict[str, str]:
    """Net amount, ratio to the total, imbalance by size, sign, and rolling sums by contract."""
    net, total = pw.sub(p, buy, sell), pw.add(p, buy, sell)
    return {"net": net, "ratio": pw.divide_nonzero(p, net, total), "s1": pw.divide_nonzero(p, net, buy), "s2": pw.divide_nonzero(p, net, sell), "s3": pw.divide_nonzero(p, net, pw.absolute(p, net)), "roll5": ts.ts_sum(p, net, 5), f"roll{window}": ts.ts_sum(p, net, window)}


def shocks(p: Layers, price: str, high: str, low: str, volume: str) -> dict[str, str]:
    """Returns over 1, 5 and 20 rows, volume shock 5 against 20, range and its deviation."""
    width = pw.divide_nonzero(p, pw.sub(p, high, low), price)
    shock = pw.divide_nonzero(p, ts.ts_mean(p, volume, 5, 2), ts.ts_mean(p, volume, 20, 6))
    return {"ret_1": ts.pct_change(p, price, 1), "ret_5": ts.pct_change(p, price, 5), "ret_20": ts.pct_change(p, price, 20), "volume_shock": p.let(f"{shock} - 1"), "width": width, "width_std": ts.ts_std(p, width, 20, 6)}


def overheat(p: Layers, fields: list[str]) -> str:
    """Sum of z-scores."""
    return p.let(" + ".join(cs.zscore(p, f, eps=1e-12) for f in fields))


def book_measures(p: Layers, bid: str, ask: str, bid_size: str, ask_size: str) -> dict[str, str]:
    """Mid, relative spread, depth, imbalance, micro-price and its distance from mid."""
    mid = pw.mean_of_two(p, bid, ask)
    depth = pw.add(p, bid_size, ask_size)
    micro = pw.divide_nonzero(p, p.let(f"{ask} * {bid_size} + {bid} * {ask_size}"), depth)
    return {"mid": mid, "spread": pw.divide_nonzero(p, pw.sub(p, ask, bid), mid), "depth": depth, "imbalance": pw.divide_nonzero(p, pw.sub(p, bid_size, ask_size), depth), "micro_gap": p.let(f"{pw.divide_nonzero(p, micro, mid)} - 1")}
