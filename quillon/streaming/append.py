"""Panels that grow: each new batch of dates is scored with the history its windows need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.plans.layers import DATE, NAME, SparkPanel
from quillon.plans.panel import densify
from quillon.plans.program import Program, compile_program


def score_append(history: DataFrame, batch: DataFrame, program: Program) -> DataFrame:
    """(Datetime, Contract, factor) for the dates of ``batch``. Of the history only the program's lookback of dates is read.

    Batches must follow the history without gaps: windows count the dates that history and batch have, so a date in
    neither is as if it had never been. Contracts that the history lacks start in the batch; those that the batch lacks
    have rows without a factor.
    """
    first = batch.agg(F.min(DATE)).first()[0]
    if first is None:
        return batch.select(DATE, NAME, F.lit(None).cast("double").alias("factor"))
    dates = history.where(F.col(DATE) < F.lit(first)).select(DATE).distinct().orderBy(F.col(DATE).desc()).limit(program.lookback + 1)
    start = dates.agg(F.min(DATE)).first()[0] or first
    d = history.where((F.col(DATE) >= F.lit(start)) & (F.col(DATE) < F.lit(first))).unionByName(batch)
    d = densify(d).withColumn("tradeable", F.coalesce("tradeable", F.lit(False)))
    p = SparkPanel(d)
    x = compile_program(p, program)
    return p.frame([x]).where(F.col(DATE) >= F.lit(first)).select(DATE, NAME, F.col(x).alias("factor"))


def run(stream: DataFrame, history: Callable[[], DataFrame], program: Program, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Score every micro-batch of new dates and hand it to ``sink`` with its number."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: sink(score_append(history(), b, program), i)).start()
