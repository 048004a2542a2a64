"""Made-up panels for trials: every draw is a hash of the seed, the column, the date and the contract, so a panel is the same
however it is partitioned, and a larger one holds the smaller one's cells."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.layers import DATE, NAME


@dataclass(frozen=True)
class MockShape:
    """Business days from ``start``, contracts, industries, the share of cells that trade, and the weight of the planted signal."""

    dates: int = 600
    contracts: int = 80
    industries: int = 8
    start: dt.date = dt.date(2020, 1, 1)
    traded: float = 0.97
    signal: float = 0.02
    lag: int = 20
    seed: int = 7


def uniform(seed: int, name: str, *keys: str) -> Column:
    """A number between 0 and 1, both excluded, fixed by seed, name and keys."""
    return (F.pmod(F.xxhash64(F.lit(f"{seed}:{name}"), *keys), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def normal(seed: int, name: str, *keys: str) -> Column:
    """A standard normal draw of two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(seed, f"{name}.r", *keys))) * F.cos(2 * F.pi() * uniform(seed, f"{name}.a", *keys))


def grid(spark: SparkSession, s: MockShape) -> DataFrame:
    """Every contract on every business day, 15:00; ``day`` numbers the days. Weekends are skipped by arithmetic, without a calendar table."""
    first = s.start + dt.timedelta(days=(7 - s.start.weekday()) % 7 if s.start.weekday() > 4 else 0)
    k = F.col("day") + first.weekday()
    offset = (F.floor(k / 5) * 7 + k % 5 - first.weekday()).cast("int")
    cells = spark.range(s.dates * s.contracts).select((F.col("id") % s.dates).alias("day"), F.floor(F.col("id") / s.dates).alias("c"))
    return cells.select(
        (F.date_add(F.lit(first), offset).cast("timestamp") + F.expr("INTERVAL 15 HOURS")).alias(DATE),
        F.format_string("M%05d", "c").alias(NAME), "day", F.concat(F.lit("ind"), (F.col("c") % s.industries).cast("string")).alias("industry"),
    )


def mock_panel(spark: SparkSession, shape: MockShape = MockShape()) -> DataFrame:
    """Prices, volumes, order-book and money-flow shares, quarterly fundamentals known ``lag`` days late, size, and a label.

    The label is the return to the next day. Returns follow ``signal`` times the day before's imbalance, so a factor of
    the imbalance has a positive rank correlation with the label, and nothing else has one by design.
    """
    s = shape
    n = lambda name, *keys: normal(s.seed, name, *(keys or (NAME, "day")))
    known = F.floor((F.col("day") - s.lag) / 63)
    df = grid(spark, s).withColumn("quarter", F.when(F.col("day") >= s.lag, known)).withColumns({
        "imbalance": F.tanh(n("imbalance")),
        "spread": F.exp(0.3 * n("spread") - 6),
        "flow_large": 0.5 * n("flow") + 0.2 * n("large"),
        "flow_small": -0.5 * n("flow") + 0.2 * n("small"),
        "volume": F.exp(12 + 0.5 * n("liquidity", NAME) + 0.4 * n("volume")),
        "profit_growth": F.when(F.col("quarter").isNotNull(), 0.1 + 0.2 * n("growth", NAME, "quarter")),
        "book_to_price": F.when(F.col("quarter").isNotNull(), F.exp(-0.7 + 0.4 * n("book", NAME, "quarter"))),
        "shares": F.exp(19 + n("shares", NAME)),
        "tradeable": uniform(s.seed, "tradeable", NAME, "day") < s.traded,
    })
    w = Window.partitionBy(NAME).orderBy(DATE)
    move = s.signal * F.coalesce(F.lag("imbalance").over(w), F.lit(0.0)) + 0.02 * n("return")
    df = df.withColumn("move", move)
    df = df.withColumn("price", 20 * F.exp(F.sum("move").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    df = df.withColumns({"amount": F.col("price") * F.col("volume"), "market_cap": F.col("price") * F.col("shares"), "label": F.lead("price").over(w) / F.col("price") - 1})
    df = df.withColumns({"size": F.log("market_cap"), "turnover": F.col("volume") / F.col("shares"), "high": F.col("price") * (1 + 0.01 * F.abs(n("high"))), "low": F.col("price") * (1 - 0.01 * F.abs(n("low")))})
    return df.drop("day", "quarter", "move")


def mock_book(panel: DataFrame, s: MockShape = MockShape()) -> DataFrame:
    """The panel with order-book columns: spread, depth, imbalance at 1 and 5 levels, micro-price distance, net bid changes of the opening and the close, intent, chase and stress."""
    n = lambda name: normal(s.seed, name, NAME, DATE)
    d = panel.withColumns({
        "ob_spread_full_mean": F.exp(0.3 * n("ob.spread") - 6), "ob_total_depth_5_full_mean": F.exp(10 + 0.4 * n("ob.depth")), "ob_imbalance_1_full_mean": F.tanh(n("ob.one")),
        "ob_imbalance_5_full_mean": F.tanh(0.7 * n("ob.one") + 0.5 * n("ob.five")), "ob_micro_price_dev_full_mean": 0.001 * n("ob.micro"),
        "ob_net_bid_change_5_open30_mean": n("ob.open"), "ob_net_bid_change_5_close30_mean": n("ob.close"), "ob_imbalance_5_close30_mean": F.tanh(n("ob.late")),
    })
    return d.withColumns({
        "ob_open_buy_intent": F.col("ob_net_bid_change_5_open30_mean") + F.col("ob_imbalance_5_full_mean") - F.col("ob_spread_full_mean"),
        "ob_close_chase_pressure": F.col("ob_imbalance_5_close30_mean") + F.col("ob_net_bid_change_5_close30_mean"),
        "ob_liquidity_stress": 3 * F.col("ob_spread_full_mean"), "ob_close_buying_vs_day": F.col("ob_imbalance_5_close30_mean") - F.col("ob_imbalance_5_full_mean"),
    })


def mock_flows(panel: DataFrame, s: MockShape = MockShape()) -> DataFrame:
    """The panel with bought and sold amounts and volumes of four order sizes and their net amount; larger orders lean with the panel's imbalance."""
    lean = {"sm": -0.2, "md": 0.0, "lg": 0.2, "elg": 0.3}
    cols = {}
    for k, (size, w) in enumerate(lean.items()):
        share = F.exp(0.3 * normal(s.seed, f"mf.{size}", NAME, DATE) - 1.2 - 0.2 * k)
        tilt = 1 / (1 + F.exp(-(w * F.col("imbalance") + 0.3 * normal(s.seed, f"mf.{size}.tilt", NAME, DATE))))
        for unit, whole in (("amount", F.col("amount")), ("vol", F.col("volume"))):
            cols |= {f"buy_{size}_{unit}": whole * share * tilt, f"sell_{size}_{unit}": whole * share * (1 - tilt)}
    d = panel.withColumns(cols)
    return d.withColumn("mf_net_amount", sum((F.col(f"buy_{x}_amount") - F.col(f"sell_{x}_amount") for x in lean), F.lit(0.0)))


STYLES = ("size", "beta", "momentum", "residual_volatility", "non_linear_size", "book_to_price", "liquidity", "earnings_yield", "growth", "leverage")


def mock_styles(panel: DataFrame, s: MockShape = MockShape(), prefix: str = "style_") -> DataFrame:
    """The panel with ten style exposures, z-scores of each date, 0 where nothing is known: size, its cube freed of size, trailing return and volatility, correlation with the mean return, and fundamentals."""
    w = Window.partitionBy(NAME).orderBy(DATE)
    past = lambda k: w.rowsBetween(-k + 1, 0)
    day = Window.partitionBy(DATE)
    d = panel.withColumn("_r", F.col("price") / F.lag("price").over(w) - 1).withColumn("_m", F.avg("_r").over(day))
    covariance = F.avg(F.col("_r") * F.col("_m")).over(past(60)) - F.avg("_r").over(past(60)) * F.avg("_m").over(past(60))
    market = F.var_pop("_m").over(past(60))
    raw = {
        "size": F.col("size"), "beta": F.when(market > 0, covariance / market), "momentum": F.col("price") / F.lag("price", 60).over(w) - 1, "residual_volatility": F.stddev_samp(F.col("_r") - F.col("_m")).over(past(60)),
        "non_linear_size": F.pow(F.col("size") - F.avg("size").over(day), 3), "book_to_price": F.col("book_to_price"), "liquidity": F.log(F.avg("turnover").over(past(20))),
        "earnings_yield": 0.05 * (1 + F.col("profit_growth")), "growth": F.col("profit_growth"), "leverage": normal(s.seed, "leverage", NAME),
    }
    d = d.withColumns({f"_{k}": v.cast("double") for k, v in raw.items()})
    z = lambda c: F.coalesce((F.col(c) - F.avg(c).over(day)) / F.when(F.stddev_samp(c).over(day) > 0, F.stddev_samp(c).over(day)), F.lit(0.0))
    return d.withColumns({f"{prefix}{k}": z(f"_{k}") for k in STYLES}).drop("_r", "_m", *[f"_{k}" for k in raw])
