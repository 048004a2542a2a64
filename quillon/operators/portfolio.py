"""Quantile portfolios of a factor: group returns, turnover, costs, drawdown."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from quillon.functions import masks
from quillon.operators.metrics import quantile_bin
from quillon.plans.layers import DATE, NAME, Layers


@dataclass(frozen=True)
class Trading:
    """Groups, dates between rebalances, costs of a full turnover, and dates in a year."""

    groups: int = 5
    every: int = 4
    commission: float = 0.0003
    slippage: float = 0.0002
    stamp: float = 0.001
    year: int = 244

    @property
    def cost(self) -> float:
        return 2 * (self.commission + self.slippage) + self.stamp

    @property
    def periods(self) -> float:
        return self.year / self.every


def grouped(p: Layers, factor: str, label: str, t: Trading) -> tuple[str, list[str]]:
    """SQL of sampled rows: date number d, contract, group g (null without factor or label), ret."""
    x, y = masks.tradeable_only(p, factor), masks.tradeable_only(p, label)
    ok = p.let(f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 ELSE 0 END")
    i = p.let(f"row_number() OVER (PARTITION BY {DATE} ORDER BY {ok} DESC, {p.ordering(x)}, {NAME})")
    n = p.let(f"sum({ok}) OVER (PARTITION BY {DATE})")
    g = p.let(f"CASE WHEN {ok} = 1 AND {n} >= {t.groups} THEN CAST({quantile_bin(i, n, str(t.groups))} AS INT) END")
    number = p.let(f"row_number() OVER (PARTITION BY {NAME} ORDER BY {DATE})")
    cols = [g, y, number]
    return f"SELECT {DATE}, CAST(({number} - 1) / {t.every} AS INT) AS d, {NAME}, {g} AS g, {y} AS ret FROM {{panel}} WHERE ({number} - 1) % {t.every} = 0", cols


def group_returns(p: Layers, factor: str, label: str, t: Trading = Trading()) -> tuple[str, list[str]]:
    """Per sampled date and group: members, sum of their returns, gross mean return, turnover against the date before (0 on the first), cost, net return."""
    base, cols = grouped(p, factor, label, t)
    sql = f"""SELECT {DATE}, d, g, members, total, gross, turnover, turnover * {t.cost!r} AS cost, gross - turnover * {t.cost!r} AS net FROM (
      SELECT {DATE}, d, g, members, total, gross, CASE WHEN members0 IS NULL THEN 0.0E0 ELSE (members - stayed + members0 - stayed) / (2.0E0 * members) END AS turnover FROM (
        SELECT *, lag(members) OVER (PARTITION BY g ORDER BY d) AS members0 FROM (
          SELECT {DATE}, d, g, count(*) AS members, sum(ret) AS total, avg(ret) AS gross, sum(CASE WHEN g0 = g THEN 1 ELSE 0 END) AS stayed
          FROM (SELECT *, lag(g) OVER (PARTITION BY {NAME} ORDER BY d) AS g0 FROM ({base}) s) b WHERE g IS NOT NULL GROUP BY {DATE}, d, g) kept) w) v"""
    return sql, cols


def long_short(p: Layers, factor: str, label: str, t: Trading = Trading()) -> tuple[str, list[str]]:
    """Per sampled date: net long (top group) and short (bottom group) returns, long less short less both costs, benchmark."""
    groups, cols = group_returns(p, factor, label, t)
    top = t.groups - 1
    pick = lambda c, g: f"max(CASE WHEN g = {g} THEN {c} END)"
    sql = f"""SELECT {DATE}, d, {pick('net', top)} AS long_ret, {pick('net', 0)} AS short_ret,
        {pick('gross', top)} - {pick('gross', 0)} - {pick('cost', top)} - {pick('cost', 0)} AS ls_ret, sum(total) / sum(members) AS benchmark,
        {pick('turnover', top)} AS long_turnover, {pick('turnover', 0)} AS short_turnover
      FROM ({groups}) r GROUP BY {DATE}, d"""
    return sql, cols


def performance(p: Layers, factor: str, label: str, t: Trading = Trading()) -> tuple[str, list[str]]:
    """One row per series (long, short, long_short): annualised return, excess, Sharpe of raw and excess returns, drawdown and its longest run, turnover, fitness.

    The daily rows are made once and dealt to the three series by a join with their names; all that follows are windows over
    one series each.
    """
    daily, cols = long_short(p, factor, label, t)
    y = repr(float(t.periods))
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    choose = lambda a, b, c: f"CASE series WHEN 'long' THEN {a} WHEN 'short' THEN {b} ELSE {c} END"
    under = "CASE WHEN round(total - peak, 12) < 0 THEN 1 ELSE 0 END"
    sql = f"""SELECT series, days, round(annual, 6) AS annual, round(annual_excess, 6) AS annual_excess, round(sharpe, 6) AS sharpe, round(excess_sharpe, 6) AS excess_sharpe, round(drawdown, 6) + 0.0E0 AS drawdown,
        CAST(longest AS BIGINT) AS drawdown_days, round(turnover, 6) AS turnover, round(sharpe * sqrt(abs(annual) / greatest(turnover, 0.125E0)), 6) AS fitness FROM (
      SELECT series, count(*) AS days, avg(ret) * {y} AS annual, avg(excess) * {y} AS annual_excess, CASE WHEN stddev_samp(ret) > 1E-12 THEN avg(ret) / stddev_samp(ret) * sqrt({y}) ELSE 0 END AS sharpe,
        CASE WHEN stddev_samp(excess) > 1E-12 THEN avg(excess) / stddev_samp(excess) * sqrt({y}) ELSE 0 END AS excess_sharpe, min(total - peak) AS drawdown, max(below) AS longest, avg(turnover) AS turnover FROM (
        SELECT *, sum({under}) OVER (PARTITION BY series, island) AS below FROM (
          SELECT *, sum(1 - {under}) OVER (PARTITION BY series ORDER BY d {run}) AS island FROM (
            SELECT *, max(total) OVER (PARTITION BY series ORDER BY d {run}) AS peak FROM (
              SELECT *, sum(side * ret) OVER (PARTITION BY series ORDER BY d {run}) AS total FROM (
                SELECT *, CASE WHEN avg(ret) OVER (PARTITION BY series) > 0 THEN 1 ELSE -1 END AS side FROM (
                  SELECT series, d, {choose('long_ret', 'short_ret', 'ls_ret')} AS ret, {choose('long_ret - benchmark', 'short_ret - benchmark', 'ls_ret')} AS excess,
                    {choose('long_turnover', 'short_turnover', '(long_turnover + short_turnover) / 2')} AS turnover
                  FROM ({daily}) daily CROSS JOIN (VALUES ('long'), ('short'), ('long_short')) names (series)) s WHERE ret IS NOT NULL) k) m) h) u) i GROUP BY series) q"""
    return sql, cols


def numeric_entries(summary: Mapping[str, object]) -> dict[str, float]:
    """The numbers of a summary; flags, texts, missing and infinite values go."""
    return {k: float(v) for k, v in summary.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)}


def top_set_return(p: Layers, factor: str, label: str, t: Trading = Trading()) -> tuple[str, list[str]]:
    """One row: annualised net return of the ceil(names / groups) best names, held equally, over sampled dates with two names or more; turnover against the sampled date before that had any."""
    x, y = masks.tradeable_only(p, factor), masks.tradeable_only(p, label)
    ok = p.let(f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 ELSE 0 END")
    i = p.let(f"row_number() OVER (PARTITION BY {DATE} ORDER BY {ok} DESC, {p.ordering(x)} DESC, {NAME})")
    n = p.let(f"sum({ok}) OVER (PARTITION BY {DATE})")
    number = p.let(f"row_number() OVER (PARTITION BY {NAME} ORDER BY {DATE})")
    held = p.let(f"CASE WHEN {ok} = 1 AND {i} <= ceil({n} * 1.0E0 / {t.groups}) THEN 1 ELSE 0 END")
    sql = f"""SELECT count(*) AS dates, round(avg(net) * {float(t.periods)!r} + 1.3E-10, 6) + 0.0E0 AS annual FROM (
      SELECT d, gross - CASE WHEN held0 IS NULL THEN 0 ELSE (held + held0 - 2 * stayed) / (2.0E0 * held) END * {t.cost!r} AS net FROM (
        SELECT d, held, gross, stayed, lag(held) OVER (ORDER BY d) AS held0 FROM (
          SELECT d, sum(held) AS held, avg(CASE WHEN held = 1 THEN ret END) AS gross, sum(held * coalesce(before, 0)) AS stayed FROM (
            SELECT ({number} - 1) / {t.every} AS d, {held} AS held, {y} AS ret, lag({held}) OVER (PARTITION BY {NAME} ORDER BY {number}) AS before FROM {{panel}} WHERE ({number} - 1) % {t.every} = 0 AND {n} >= 2) s GROUP BY d) g) h) r"""
    return sql, [x, y, ok, i, n, number, held]


def top_fraction_groups(fraction: float) -> int:
    """Groups that make the top one a given fraction: max(2, round(1 / fraction)); 5 for a fraction that isn't in (0, 1)."""
    return max(2, round(1 / fraction)) if 0 < fraction < 1 else 5
