"""Rolling windows of dates and splits of a panel into dates to learn on and dates to judge on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.layers import DATE


@dataclass(frozen=True)
class Rolling:
    """``stride`` dates are judged at a time, after a gap of ``horizon`` dates in which labels still reach into them."""

    stride: int = 120
    horizon: int = 20
    kind: str = "sliding"

    def __post_init__(self) -> None:
        if self.stride <= 0 or self.horizon < 0 or self.kind not in ("sliding", "expanding"):
            raise ValueError("stride is positive, horizon isn't negative, kind is sliding or expanding")


def rolling_windows(df: DataFrame, train_start: str, test_start: str, rolling: Rolling = Rolling()) -> DataFrame:
    """(window, train_start, train_end, test_start, test_end) over the table's distinct dates; the last window may be shorter.

    Windows follow from the dates' numbers, so only distinct dates are numbered, and four of them looked up per window.
    """
    days = df.select(F.col(DATE).alias("day")).distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    edge = days.agg(F.count("*").alias("n"), F.min(F.when(F.col("day") >= F.lit(train_start).cast("timestamp"), F.col("i"))).alias("a"), F.min(F.when(F.col("day") >= F.lit(test_start).cast("timestamp"), F.col("i"))).alias("b")).first()
    if edge["a"] is None or edge["b"] is None:
        return df.sparkSession.createDataFrame([], "window int, train_start timestamp, train_end timestamp, test_start timestamp, test_end timestamp")
    span = edge["b"] - edge["a"] - rolling.horizon
    if span <= 0:
        raise ValueError("no dates to train on before the first test date")
    rows = []
    for k, t in enumerate(range(edge["b"], edge["n"], rolling.stride)):
        first = max(0, t - rolling.horizon - span) if rolling.kind == "sliding" else edge["a"]
        rows.append((k, first, t - rolling.horizon - 1, t, min(t + rolling.stride, edge["n"]) - 1))
    bounds = df.sparkSession.createDataFrame(rows, "window int, a int, b int, c int, d int").unpivot("window", ["a", "b", "c", "d"], "edge", "i")
    dated = bounds.join(days, "i").groupBy("window").pivot("edge", ["a", "b", "c", "d"]).agg(F.first("day"))
    return dated.select("window", F.col("a").alias("train_start"), F.col("b").alias("train_end"), F.col("c").alias("test_start"), F.col("d").alias("test_end"))


def split(df: DataFrame, share: float = 0.7, gap: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows of the first ``share`` of the distinct dates, and of the dates ``gap`` after those."""
    if not 0 < share < 1 or gap < 0:
        raise ValueError("the share is between 0 and 1, the gap isn't negative")
    days = df.select(DATE).distinct().withColumn("_i", F.row_number().over(Window.orderBy(DATE)))
    cut = int(days.count() * share)
    return df.join(days.where(F.col("_i") <= cut).select(DATE), DATE, "left_semi"), df.join(days.where(F.col("_i") > cut + gap).select(DATE), DATE, "left_semi")


def split_at(df: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """Rows before a date, and from it on."""
    at = F.lit(date).cast("timestamp")
    return df.where(F.col(DATE) < at), df.where(F.col(DATE) >= at)
