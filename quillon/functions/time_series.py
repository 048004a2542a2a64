"""Functions over a contract's trailing rows of the dense grid. Unless noted, the current value must be known."""

from __future__ import annotations

from quillon.functions import cross_section as cs
from quillon.functions import pointwise as pw
from quillon.plans.layers import DATE, NAME, Layers

#: Windows and selection sizes for which functions are registered.
WINDOWS, SELECT_COUNTS = (5, 20, 60, 120), (1, 3, 5)


def _over(p: Layers, f: str, x: str, w: int) -> str:
    return p.let(f"{f}({x}) OVER ({p.trailing(w)})")


def delay(p: Layers, x: str, w: int) -> str:
    """The value w rows before, whether the current one is known or not."""
    return p.let(f"lag({x}, {w}) OVER ({p.T})")


def ts_delta(p: Layers, x: str, w: int) -> str:
    return p.let(f"{x} - {delay(p, x, w)}")


def ts_return(p: Layers, x: str, w: int) -> str:
    return p.let(f"{pw.divide(p, x, delay(p, x, w))} - 1")


def pct_change(p: Layers, x: str, w: int) -> str:
    return p.let(f"{pw.divide_nonzero(p, x, delay(p, x, w))} - 1")


def ts_mean(p: Layers, x: str, w: int, least: int | None = None) -> str:
    m, n = _over(p, "avg", x, w), _over(p, "count", x, w)
    return p.let(f"CASE WHEN {x} IS NOT NULL AND {n} >= {least or w} THEN {m} END")


def ts_std(p: Layers, x: str, w: int, least: int | None = None) -> str:
    s, n = _over(p, "stddev_samp", x, w), _over(p, "count", x, w)
    return p.let(f"CASE WHEN {x} IS NOT NULL AND {n} >= {max(2, least or w)} THEN {s} END")


def ts_sum(p: Layers, x: str, w: int, least: int = 1) -> str:
    s, n = _over(p, "sum", x, w), _over(p, "count", x, w)
    return p.let(f"CASE WHEN {n} >= {least} THEN {s} END")


def ts_median(p: Layers, x: str, w: int) -> str:
    return p.sliding_median(x, w)


def ts_zscore(p: Layers, x: str, w: int, least: int | None = None) -> str:
    m, s = ts_mean(p, x, w, least), ts_std(p, x, w, least)
    return p.let(f"CASE WHEN {s} > 1E-8 THEN ({x} - {m}) / ({s} + 1E-8) END")


def ts_zscore_partial(p: Layers, x: str, w: int) -> str:
    """As ts_zscore, from max(5, w // 3) values on."""
    return ts_zscore(p, x, w, max(5, w // 3))


def ts_max_to_min(p: Layers, x: str, w: int) -> str:
    a, b, n = _over(p, "max", x, w), _over(p, "min", x, w), _over(p, "count", x, w)
    return p.let(f"CASE WHEN {x} IS NOT NULL AND {n} >= {w} THEN {a} - {b} END")


def ts_meanrank(p: Layers, x: str, w: int) -> str:
    return ts_mean(p, cs.rank_pct(p, x), w)


def diff_sign(p: Layers, x: str, w: int) -> str:
    """Sign of what the value differs from its mean by."""
    return p.let(f"CAST(sign({p.ordering(p.let(f'{x} - {ts_mean(p, x, w)}'))}) AS DOUBLE)")


def pair_moments(p: Layers, x: str, y: str, w: int) -> tuple[str, ...]:
    """(n, covariance, variance of x, variance of y) over a window's jointly known rows, as population moments."""
    ok = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    a, b = p.let(f"CASE WHEN {ok} THEN {x} END"), p.let(f"CASE WHEN {ok} THEN {y} END")
    n = _over(p, "count", a, w)
    c = p.let(f"covar_pop({a}, {b}) OVER ({p.trailing(w)})")
    return n, c, _over(p, "var_pop", a, w), _over(p, "var_pop", b, w)


def ts_corr(p: Layers, x: str, y: str, w: int, least: int | None = None) -> str:
    n, c, va, vb = pair_moments(p, x, y, w)
    return p.let(f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL AND {n} >= {max(2, least or w)} AND {va} > 0 AND {vb} > 0 AND sqrt({va}) * sqrt({vb}) * {n} > 1E-8 THEN {c} / (sqrt({va}) * sqrt({vb})) END")


def rolling_selmean_diff(p: Layers, x: str, y: str, w: int, n: int) -> str:
    """Mean of x where y is among its n largest in the window, less that of its n smallest; ties by time."""
    if n > w:
        raise ValueError("more rows selected than the window has")
    return p.let(f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {p.let(p.selected_means(x, y, w, n))} END")


def decay_linear(p: Layers, x: str, w: int) -> str:
    """Mean weighted 1..w from oldest to newest, over known values; from w values on.

    With row number i and current row c a weight is i - c + w, so two plain sums over the frame are enough.
    """
    i = p.let(f"row_number() OVER ({p.T})")
    known = p.let(f"CASE WHEN {x} IS NOT NULL THEN {i} END")
    xi = p.let(f"{x} * {i}")
    sxi, sx, si, n = _over(p, "sum", xi, w), _over(p, "sum", x, w), _over(p, "sum", known, w), _over(p, "count", x, w)
    return p.let(f"CASE WHEN {x} IS NOT NULL AND {n} >= {w} THEN ({sxi} - ({i} - {w}) * {sx}) / ({si} - ({i} - {w}) * {n}) END")


def forward_return(p: Layers, x: str, h: int) -> str:
    """Return over the next h rows."""
    later = p.let(f"lead({x}, {h}) OVER ({p.T})")
    return p.let(f"CASE WHEN {x} <> 0 THEN {later} / {x} - 1 END")


def ffill(p: Layers, x: str, limit: int | None = None) -> str:
    """The last known value, at most ``limit`` rows old."""
    over = f"{p.T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    last = p.let(p.last_known(x, over))
    if limit is None:
        return last
    i = p.let(f"row_number() OVER ({p.T})")
    at = p.let(f"max(CASE WHEN {x} IS NOT NULL THEN {i} END) OVER ({over})")
    return p.let(f"CASE WHEN {i} - {at} <= {limit} THEN {last} END")


def last_revision(p: Layers, x: str) -> str:
    """The last change of a value that wasn't zero."""
    d = ts_delta(p, x, 1)
    return ffill(p, p.let(f"CASE WHEN {d} <> 0 THEN {d} END"))


def update_flag(p: Layers, x: str, eps: float = 1e-12) -> str:
    return p.let(f"CASE WHEN abs({ts_delta(p, x, 1)}) > {eps:.0E} THEN 1.0E0 ELSE 0.0E0 END")


def sum_ratio(p: Layers, x: str, y: str, w: int) -> str:
    """Sum of x over sum of y in the window, from max(3, w // 3) rows on."""
    return pw.divide_nonzero(p, ts_sum(p, x, w, max(3, w // 3)), ts_sum(p, y, w, max(3, w // 3)))


def market_corr(p: Layers, x: str, w: int) -> str:
    """Rolling correlation with the mean over all contracts of the date."""
    return ts_corr(p, x, p.let(f"avg({x}) OVER ({p.P})"), w, max(2, w // 3))


def drawdown(p: Layers, x: str, w: int) -> str:
    """Value over the window's maximum, less one."""
    return p.let(f"{pw.divide_nonzero(p, x, _over(p, 'max', x, w))} - 1")


def vwap_gap(p: Layers, price: str, amount: str, volume: str, w: int) -> str:
    return p.let(f"{pw.divide_nonzero(p, price, pw.divide_nonzero(p, ts_sum(p, amount, w), ts_sum(p, volume, w)))} - 1")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "cs", "pw", "DATE", "NAME", "Layers")]
