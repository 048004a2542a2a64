"""The operators programs may use, by name. ``register`` extends them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from quillon.functions import cross_section as cs
from quillon.functions import masks
from quillon.functions import pointwise as pw
from quillon.functions import time_series as ts

Builder = Callable[..., str]


@dataclass(frozen=True)
class Operator:
    """A column builder f(panel, *columns) with what the search needs to know about it."""

    name: str
    arity: int
    category: str
    output: str
    cost: float
    build: Builder


OPERATORS: dict[str, Operator] = {}


def register(name: str, arity: int, category: str, cost: float, build: Builder, output: str = "numeric") -> Operator:
    """Add an operator; a name is taken once."""
    if name in OPERATORS:
        raise ValueError(f"operator {name!r} exists")
    OPERATORS[name] = Operator(name, arity, category, output, cost, build)
    return OPERATORS[name]


def operators(category: str | None = None, output: str | None = None) -> list[Operator]:
    return [o for o in OPERATORS.values() if category in (None, o.category) and output in (None, o.output)]


def _fill() -> None:
    # Names, arities and costs of the operator library.
    for name, arity, cost, f in (
        ("neg", 1, 0.2, pw.neg), ("abs", 1, 0.2, pw.absolute), ("sign", 1, 0.3, pw.sign), ("slog", 1, 0.4, pw.slog), ("sqrt_abs", 1, 0.4, pw.sqrt_abs),
        ("add", 2, 0.3, pw.add), ("sub", 2, 0.3, pw.sub), ("mul", 2, 0.4, pw.mul), ("qdiv", 2, 0.6, pw.divide),
    ):
        register(name, arity, "pointwise", cost, f)
    for name, arity, cost, f in (("cs_rank", 1, 1.0, cs.rank_pct), ("cs_zscore", 1, 1.0, cs.zscore), ("cs_demean", 1, 0.8, cs.demean), ("cs_winsorize_5pct", 1, 1.2, cs.winsorize), ("cs_resid", 2, 3.0, cs.residual)):
        register(name, arity, "cross_section", cost, f)
    for name, cost, f in (
        ("mask_rank_high_50", 0.9, partial(masks.rank_high, at=0.5)), ("mask_rank_high_80", 1.0, partial(masks.rank_high, at=0.8)), ("mask_rank_low_20", 1.0, partial(masks.rank_low, at=0.2)),
        ("mask_sign_pos", 0.3, masks.sign_pos), ("mask_sign_neg", 0.3, masks.sign_neg),
    ):
        register(name, 1, "mask", cost, f, "mask")
    register("gate_nan", 2, "gate", 0.5, masks.gate_nan)
    register("gate_zero", 2, "gate", 0.5, masks.gate_zero)
    windowed = (
        ("delay", 1, 0.4), ("ts_delta", 1, 0.6), ("ts_return", 1, 0.7), ("ts_mean", 1, 1.0), ("ts_median", 1, 1.4), ("ts_std", 1, 1.2), ("ts_zscore", 1, 1.4),
        ("ts_max_to_min", 1, 1.3), ("ts_meanrank", 1, 1.6), ("diff_sign", 1, 1.2), ("decay_linear", 1, 1.3), ("ts_corr", 2, 2.0),
    )
    for w in ts.WINDOWS:
        for name, arity, cost in windowed:
            register(f"{name}_{w}", arity, "time_series", cost + w / 120, partial(getattr(ts, name), w=w))
        for n in ts.SELECT_COUNTS:
            if n <= w:
                register(f"rolling_selmean_diff_{w}_n{n}", 2, "time_series", 2.8 + w / 80 + n / 10, partial(ts.rolling_selmean_diff, w=w, n=n))


_fill()
