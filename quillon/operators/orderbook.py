"""Order-book ticks to days: measures of each tick, sessions' statistics in one pass, and composites of those."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.alignment import CONTINUOUS, sessions
from quillon.plans.layers import DATE, NAME

# Fields of a tick, measures that are summed up, sessions of a day, and columns that are kept.
FIELDS = ("BP1", "SP1", "BV1", "BV2", "BV3", "BV4", "BV5", "SV1", "SV2", "SV3", "SV4", "SV5")
MEASURES = (
    "ob_spread", "ob_bid_depth_5", "ob_ask_depth_5", "ob_total_depth_5", "ob_imbalance_1", "ob_imbalance_3", "ob_imbalance_5", "ob_micro_price_dev", "ob_book_shape_gap",
    "ob_net_bid_change_1", "ob_net_bid_change_5", "ob_net_bid_change_5_ratio",
)
SESSIONS = {"full": ("00:00", "23:59"), "open30": ("09:35", "10:00"), "amclose30": ("11:05", "11:30"), "pmopen30": ("13:05", "13:30"), "close30": ("14:35", "15:00")}
KEPT = (
    "ob_spread_full_mean ob_spread_full_std ob_spread_full_max ob_total_depth_5_full_mean ob_total_depth_5_full_std ob_imbalance_1_full_mean ob_imbalance_5_full_mean ob_imbalance_5_full_std "
    "ob_micro_price_dev_full_mean ob_book_shape_gap_full_mean ob_spread_open30_mean ob_imbalance_5_open30_mean ob_micro_price_dev_open30_mean ob_net_bid_change_5_open30_mean "
    "ob_net_bid_change_5_open30_std ob_net_bid_change_5_open30_skew ob_imbalance_5_pmopen30_mean ob_net_bid_change_5_pmopen30_mean ob_net_bid_change_5_pmopen30_std ob_spread_close30_mean "
    "ob_imbalance_5_close30_mean ob_imbalance_5_close30_last ob_micro_price_dev_close30_mean ob_net_bid_change_5_close30_mean ob_net_bid_change_5_close30_std ob_net_bid_change_5_full_mean "
    "ob_net_bid_change_5_full_std ob_net_bid_change_5_ratio_full_mean ob_open_buy_intent ob_close_chase_pressure ob_liquidity_stress ob_close_buying_vs_day"
).split()


def _over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def tick_measures(ticks: DataFrame, order: Sequence[str] = (DATE,)) -> DataFrame:
    """Ticks with mid price, spread, depth and imbalance at 1, 3 and 5 levels, micro-price and its distance from mid, shares near the touch, and changes against the contract's tick before on the same day.

    ``order`` puts ticks of one contract and day in order.
    """
    c = F.col
    depth = lambda side, n: sum((c(f"{side}V{k}") for k in range(2, n + 1)), c(f"{side}V1"))
    d = ticks.withColumn("ob_mid", (c("BP1") + c("SP1")) / 2).withColumn("ob_spread", _over(c("SP1") - c("BP1"), c("ob_mid")))
    for n in (1, 3, 5):
        bid, ask = depth("B", n), depth("S", n)
        d = d.withColumns({f"ob_bid_depth_{n}": bid, f"ob_ask_depth_{n}": ask, f"ob_imbalance_{n}": _over(bid - ask, bid + ask)})
    d = d.withColumns({
        "ob_total_depth_5": c("ob_bid_depth_5") + c("ob_ask_depth_5"),
        "ob_micro_price": _over(c("SP1") * c("BV1") + c("BP1") * c("SV1"), c("BV1") + c("SV1")),
        "ob_bid_near_share": _over(c("BV1") + c("BV2"), c("ob_bid_depth_5")), "ob_ask_near_share": _over(c("SV1") + c("SV2"), c("ob_ask_depth_5")),
    })
    w = Window.partitionBy(NAME, F.to_date(DATE)).orderBy(*order)
    change = lambda n: c(f"ob_bid_depth_{n}") - F.lag(f"ob_bid_depth_{n}").over(w) - (c(f"ob_ask_depth_{n}") - F.lag(f"ob_ask_depth_{n}").over(w))
    d = d.withColumns({"ob_micro_price_dev": _over(c("ob_micro_price") - c("ob_mid"), c("ob_mid")), "ob_book_shape_gap": c("ob_bid_near_share") - c("ob_ask_near_share"), "ob_net_bid_change_1": change(1), "ob_net_bid_change_5": change(5)})
    return d.withColumn("ob_net_bid_change_5_ratio", _over(c("ob_net_bid_change_5"), c("ob_total_depth_5")))


def _moments(x: str) -> list[Column]:
    """Of some values: their number, mean, sums of squares and cubes about it, last known, largest and least. Those of several parts merge."""
    n, squares = F.count(x).cast("double"), F.var_pop(x) * F.count(x)
    cubes = F.when(squares > 0, F.skewness(x) * F.pow(squares, 1.5) / F.sqrt(n)).otherwise(0.0)
    return [n.alias("n"), F.avg(x).alias("mean"), squares.alias("squares"), cubes.alias("cubes"), F.max("_last").alias("last"), F.max(x).alias("max"), F.min(x).alias("min")]


def _merged(bit: int) -> str:
    """SQL: statistics of all values of those moments in the array _parts that have a session's bit: mean, deviation, skewness with the sample correction, last, largest, least.

    Steps pass through arrays of one, so that each value is written once.
    """
    total = lambda of, rows: f"aggregate({rows}, 0D, (s, p) -> s + {of})"
    apart = "(p.mean - c.mean)"
    steps = f"array(filter(_parts, p -> (p._in & {bit}) != 0 AND p.n > 0))"
    steps = f"transform({steps}, a -> named_struct('got', a, 'n', {total('p.n', 'a')}, 'sum', {total('p.n * p.mean', 'a')}))"
    steps = f"transform({steps}, b -> named_struct('got', b.got, 'n', b.n, 'mean', b.sum / nullif(b.n, 0D)))"
    squares = total(f"p.squares + p.n * {apart} * {apart}", "c.got")
    cubes = total(f"p.cubes + 3 * {apart} * p.squares + p.n * {apart} * {apart} * {apart}", "c.got")
    steps = f"transform({steps}, c -> named_struct('got', c.got, 'n', c.n, 'mean', c.mean, 'squares', {squares}, 'cubes', {cubes}))"
    skew = "sqrt(d.n) * d.cubes / pow(d.squares, 1.5) * sqrt(d.n * (d.n - 1)) / (d.n - 2)"
    found = {
        "mean": "d.mean",
        "std": "CASE WHEN d.n > 1 THEN sqrt(d.squares / (d.n - 1)) END",
        "skew": f"CASE WHEN d.n > 2 THEN CASE WHEN d.squares / d.n > 1E-20 THEN {skew} ELSE 0D END END",
        "last": "array_max(transform(d.got, p -> p.last)).v",
        "max": "array_max(transform(d.got, p -> p.max))",
        "min": "array_min(transform(d.got, p -> p.min))",
    }
    return f"transform({steps}, d -> named_struct({', '.join(f"'{k}', {v}" for k, v in found.items())}))[0]"


def daily_book(measured: DataFrame, measures: Sequence[str] = MEASURES, parts: dict[str, tuple[str, str]] | None = None, order: Sequence[str] = (DATE,), close: str = "15 HOURS") -> DataFrame:
    """(Datetime, Contract, <measure>_<session>_<statistic>...): mean, deviation, skew, last known, largest and least value of each measure in each session.

    Three narrow layers. Ticks of a day, contract and measure that are in the same sessions become one row of moments, most
    of it before anything is exchanged; of these few rows each session merges its own, the whole day all; and a day's
    measures are brought side by side.
    """
    sessions_of = list((SESSIONS if parts is None else parts).items())
    t = F.date_format(DATE, "HH:mm")
    within = [F.lit(True) if name == "full" else t.between(lo, hi) for name, (lo, hi) in sessions_of]
    in_sessions = sum((F.when(w, 1 << k).otherwise(0) for k, w in enumerate(within)), F.lit(0))
    day = (F.date_trunc("day", DATE) + F.expr(f"INTERVAL {close}")).alias(DATE)
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("_measure"), F.col(m).cast("double").alias("_v")) for m in measures]))
    rows = measured.select(day, NAME, in_sessions.alias("_in"), F.struct(*order).alias("_order"), each)
    rows = rows.withColumn("_last", F.when(F.col("_v").isNotNull(), F.struct("_order", F.col("_v").alias("v"))))
    moments = rows.groupBy(DATE, NAME, "_measure", "_in").agg(*_moments("_v"))
    own = moments.groupBy(DATE, NAME, "_measure").agg(F.collect_list(F.struct("_in", "n", "mean", "squares", "cubes", "last", "max", "min")).alias("_parts"))
    numbers = range(len(sessions_of))
    own = own.selectExpr(DATE, NAME, "_measure", f"named_struct({', '.join(f"'_s{k}', {_merged(1 << k)}" for k in numbers)}) AS _stats")
    wide = own.groupBy(DATE, NAME).agg(*[F.first(F.when(F.col("_measure") == m, F.col("_stats")), ignorenulls=True).alias(f"_m{i}") for i, m in enumerate(measures)])
    statistics = ("mean", "std", "skew", "last", "max", "min")
    columns = [f"_m{i}._s{k}.{s} AS `{m}_{name}_{s}`" for k, (name, _) in enumerate(sessions_of) for i, m in enumerate(measures) for s in statistics]
    return wide.selectExpr(DATE, NAME, *columns)


def composites(daily: DataFrame) -> DataFrame:
    """Opening intent, closing pressure, stress, and closing imbalance against the day's."""
    c = F.col
    return daily.withColumns({
        "ob_open_buy_intent": c("ob_net_bid_change_5_open30_mean") + c("ob_imbalance_5_open30_mean") - c("ob_spread_open30_mean"),
        "ob_close_chase_pressure": c("ob_imbalance_5_close30_mean") + c("ob_micro_price_dev_close30_mean") + c("ob_net_bid_change_5_close30_mean"),
        "ob_liquidity_stress": c("ob_spread_full_max") + 2 * c("ob_spread_full_std"),
        "ob_close_buying_vs_day": c("ob_imbalance_5_close30_mean") - c("ob_imbalance_5_full_mean"),
    })


def book_days(ticks: DataFrame, order: Sequence[str] = (DATE,), ranges: Sequence[tuple[str, str]] = CONTINUOUS, keep: Sequence[str] | None = None) -> DataFrame:
    """Ticks of continuous trading to days with composites; ``keep`` names the columns that stay."""
    out = composites(daily_book(tick_measures(sessions(ticks, ranges), order), order=order))
    return out if keep is None else out.select(DATE, NAME, *keep)
