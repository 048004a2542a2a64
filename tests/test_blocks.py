import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import cross_section as cs
from quillon.functions import time_series as ts
from quillon.plans.blocks import AT, BLOCK, BlockedPanel, reach
from quillon.plans.layers import DATE, NAME, Layers, SparkPanel


@pytest.fixture(scope="module")
def table(spark):
    """Half of all rows are one contract's; gaps, ties and contracts of one row are among them."""
    rng = np.random.default_rng(5)
    rows = []
    for name, n in (("hot", 600), ("a", 300), ("b", 250), ("c", 30), ("d", 1), ("e", 2)):
        for k in range(n):
            x = None if rng.random() < (0.9 if 100 < k < 420 else 0.1) else float(np.round(rng.normal(), 2))
            y = None if rng.random() < 0.02 else float(rng.integers(0, 9))
            rows.append((dt.datetime(2020, 1, 1) + dt.timedelta(days=k), name, x, y))
    return spark.createDataFrame(pd.DataFrame(rows, columns=[DATE, NAME, "x", "y"]).astype({"x": float, "y": float})).withColumn("x", F.nanvl("x", F.lit(None))).withColumn("y", F.nanvl("y", F.lit(None))).repartition(3)


#: Windows, shifts both ways, walks, carries with and without a limit, dates in between, and chains of them.
FUNCTIONS = {
    "delay": lambda p: ts.delay(p, "x", 70),
    "mean": lambda p: ts.ts_mean(p, "y", 20, 3),
    "deep": lambda p: ts.ts_std(p, ts.ts_delta(p, ts.ts_mean(p, "y", 20, 3), 5), 30, 2),
    "median": lambda p: ts.ts_median(p, "y", 5),
    "selected": lambda p: ts.rolling_selmean_diff(p, "y", ts.ts_sum(p, "y", 3), 7, 2),
    "decay": lambda p: ts.decay_linear(p, "y", 10),
    "ahead": lambda p: ts.forward_return(p, "y", 40),
    "both": lambda p: ts.forward_return(p, ts.ts_sum(p, "y", 9), 4),
    "fill": lambda p: ts.ffill(p, "x"),
    "fill_limit": lambda p: ts.ffill(p, "x", 3),
    "revision": lambda p: ts.ts_sum(p, ts.last_revision(p, "x"), 6),
    "ranked": lambda p: ts.ts_meanrank(p, "y", 12),
    "rank_of_fill": lambda p: cs.rank_pct(p, ts.ts_mean(p, ts.ffill(p, "x"), 4)),
    "market": lambda p: ts.market_corr(p, "y", 15),
    "running_max": lambda p: p.let(f"max(x) OVER ({Layers.T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "running_sum": lambda p: p.let(f"sum(y) OVER ({Layers.T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "running_count": lambda p: p.let(f"count(x) OVER ({Layers.T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
}


def rows_of(panel):
    return panel.select({DATE: DATE, NAME: NAME} | {k: f(panel) for k, f in FUNCTIONS.items()}).toPandas().sort_values([NAME, DATE]).reset_index(drop=True)


@pytest.mark.parametrize("rows", [7, 150, 10_000])
def test_equal_to_whole_contracts(table, rows):
    """Blocks shorter than a window, blocks longer than it, and a single block."""
    pd.testing.assert_frame_equal(rows_of(BlockedPanel(table, rows_per_block=rows)), rows_of(SparkPanel(table)), check_dtype=False)


def test_a_long_contract_is_many_even_blocks(table):
    p = BlockedPanel(table, rows_per_block=60)
    sizes = p.base.groupBy(NAME, BLOCK).count().toPandas()
    assert (sizes[NAME] == "hot").sum() > 8
    assert sizes["count"].max() <= 2 * 60
    at = p.base.where("Contract = 'hot'").orderBy(DATE).select(AT).toPandas()[AT]
    assert at.tolist() == list(range(1, 601))
    assert p.cut.count() <= 2 * p.base.select(BLOCK).distinct().count()


def test_copies_are_no_rows(table):
    p = BlockedPanel(table, rows_per_block=50)
    assert p.frame([ts.ts_mean(p, "y", 60, 1), ts.forward_return(p, "y", 60)]).count() == table.count()


def test_reach():
    assert reach(f"lag(x, 3) OVER ({Layers.T})") == (3, 0)
    assert reach(f"lead(x, 4) OVER ({Layers.T})") == (0, 4)
    assert reach(f"avg(x) OVER ({Layers.trailing(20)}) - lag(x, 2) OVER ({Layers.T}) + lead(x, 1) OVER ({Layers.T})") == (19, 1)
    with pytest.raises(ValueError, match="no bound"):
        reach(f"first_value(x) OVER ({Layers.T})")


def test_dates_and_contracts_in_one_expression_are_refused(table):
    p = BlockedPanel(table, rows_per_block=100)
    c = p.let(f"avg(x) OVER ({Layers.P}) - lag(x, 1) OVER ({Layers.T})")
    with pytest.raises(ValueError, match="columns of their own"):
        p.frame([c])


def test_empty_and_wrong(table):
    p = BlockedPanel(table.where("false"))
    assert p.frame([ts.ts_mean(p, "y", 5), ts.ffill(p, "x")]).count() == 0
    with pytest.raises(ValueError):
        BlockedPanel(table, rows_per_block=0)


def test_every_registered_operator_has_bounds(table):
    from quillon.functions.registry import OPERATORS

    p = BlockedPanel(table, rows_per_block=100)
    wanted = [o.build(p, *(["x", "y"][: o.arity])) for o in OPERATORS.values()]
    steps = p.steps(wanted)
    assert max(s.back for s in steps) >= 119
    assert {k for s in steps for layer in s.layers for k in layer} == {k for layer in p.layers(wanted) for k in layer}


def test_candidates_score_the_same_on_blocks(spark):
    from quillon.operators.evolve import Kind, score_batch
    from quillon.operators.search import compile_program
    from quillon.plans.panel import PanelContext, prepare
    from quillon.plans.program import Program, call, field

    rng = np.random.default_rng(2)
    rows = [(dt.datetime(2021, 1, 1, 15) + dt.timedelta(days=k), f"c{c}", float(rng.normal()), float(rng.normal()), 1.0) for k in range(40) for c in range(8)]
    df = spark.createDataFrame(rows, [DATE, NAME, "x", "label", "tradeable"])
    programs = [Program(call("ts_mean_5", field("x"))), Program(call("cs_rank", call("ts_delta_20", field("x"))))]
    kind = Kind(lambda: programs[0], lambda alive: programs[1], compile_program, lambda p: p.key)
    blocked = prepare(df, PanelContext(), blocked=True, rows_per_block=50)
    assert PanelContext().fields(blocked.base) == ["x"]
    whole, cut = score_batch(prepare(df, PanelContext()), kind, programs), score_batch(blocked, kind, programs)
    assert [s.days for s in whole] == [s.days for s in cut] and all(s.days for s in whole)
    assert np.allclose([(s.ic, s.ir, s.coverage) for s in whole], [(s.ic, s.ir, s.coverage) for s in cut])
