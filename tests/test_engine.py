"""Programs, templates, selection, panels, sources, and queries against the second engine."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillon import queries as q
from quillon import table_queries as tq
from quillon.operators import lasso, selection
from quillon.operators.regression import residuals
from quillon.operators.search import Generator, SearchConfig
from quillon.plans import templates as tp
from quillon.plans.layers import DATE, NAME
from quillon.plans.panel import PanelError, clean, densify, validate_panel, weekly_text
from quillon.plans.program import Program, call, check, const, field
from quillon.sources import tables
from quillon.streaming.append import score_append

SF = "/root/testdata/sf0.001"


def test_program_round_trip_and_keys():
    for root in q.PROGRAMS.values():
        p = Program(root)
        assert Program.from_json(p.to_json()) == p and not check(p)
    a, b = call("add", field("x"), field("y")), call("add", field("y"), field("x"))
    assert Program(a).key == Program(b).key and Program(call("sub", field("x"), field("y"))).key != Program(call("sub", field("y"), field("x"))).key


def test_program_errors():
    bad = call("gate_nan", field("x"), field("y"))
    assert check(Program(bad)) and check(Program(field("x")), ["y"]) and check(Program(const(float("nan")))) and check(Program(call("mask_sign_pos", field("x"))))
    assert Program(call("ts_mean_20", call("delay_5", field("x")))).lookback == 25


def test_generator_is_closed():
    g = Generator(["a", "b"], SearchConfig(max_depth=4))
    alive = [g.random() for _ in range(20)]
    for _ in range(60):
        assert g.ok(g.offspring(alive))
    assert [str(p) for p in (Generator(["a"], SearchConfig()).random(), Generator(["a"], SearchConfig()).random())][0] == str(Generator(["a"], SearchConfig()).random())


def test_registry_size():
    assert len(q.OPERATOR_NAMES) == 81


def test_fronts_and_elites():
    goals = [(1, 1), (0.9, 1.2), (0.5, 0.5), (1.1, 0.8)]
    assert sorted(selection.fronts(goals)[0]) == [0, 1, 3] and selection.dominates((1, 1), (0.5, 0.5))
    assert 2 not in selection.elites(goals, 3) and selection.elites(goals, 2, [3, 1, 1, 2])[0] == 1
    assert selection.fronts([(float("nan"), 0), (1, 1)]) == [[1], [0]]
    rng = random.Random(0)
    pts = [(rng.random(), rng.random()) for _ in range(30)]
    first = set(selection.fronts(pts)[0])
    assert first == {i for i, a in enumerate(pts) if not any(selection.dominates(b, a) for b in pts)}


def peeled(points):
    """Front of each point, by all pairs."""
    m = np.array(points, float)
    beats = (m[:, None] >= m[None]).all(2) & (m[:, None] > m[None]).any(2)
    front, left = np.full(len(m), -1), np.arange(len(m))
    for k in range(len(m)):
        top = left[~beats[np.ix_(left, left)].any(0)]
        front[top] = k
        left = np.setdiff1d(left, top)
    return front.tolist()


@pytest.mark.parametrize("width", [1, 2, 3])
def test_fronts_against_all_pairs(width):
    rng = np.random.default_rng(width)
    for n, values in ((1, 9), (80, 4), (80, 1000), (300, 12)):
        points = rng.integers(0, values, (n, width)).astype(float)
        points[rng.random((n, width)) < 0.05] = -np.inf
        got = selection.fronts(points)
        assert sorted(i for f in got for i in f) == list(range(n)) and all(f == sorted(f) for f in got)
        want = peeled(points)
        assert all(want[i] == k for k, f in enumerate(got) for i in f)
    assert selection.fronts([]) == []


def test_selection_ranks_every_candidate(spark, tmp_path):
    r = random.Random(1)
    rows = [(c, round(r.uniform(1, 100), 2)) for c in range(1, 701) for _ in range(r.randint(1, 9))]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem", "events"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    points = [(x.f1, x.f2) for x in spark.read.parquet(f"{tmp_path}/orders.parquet").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 2).alias("f1"), F.count("*").alias("f2")).orderBy("o_custkey").collect()]
    got = tq.se4_selection(spark, str(tmp_path)).collect()
    front = {x.id: x.front for x in got}
    assert len(got) == 700 and [front[c] for c in range(1, 701)] == peeled(points)
    for k in set(front.values()):
        members = [c for c in range(1, 701) if front[c] == k]
        want = selection.crowding(points, [c - 1 for c in members])
        assert {x.id: x.crowding for x in got if x.front == k} == {c: pytest.approx(min(want[c - 1], 1e9)) for c in members}
    assert [(x.front, -x.crowding) for x in got] == sorted((x.front, -x.crowding) for x in got)


def test_behaviour_rules():
    ok = tp.BehaviourGene("panic_reversal", "panic_reversal", {s: tp.Slot("price") for s in ("fund_anchor", "drawdown", "sell_pressure")})
    assert not tp.check_behaviour(ok)
    assert tp.check_behaviour(tp.BehaviourGene("panic_reversal", "confirm", {})) and tp.check_behaviour(tp.BehaviourGene("x", "y", {}))
    a = tp.StructuredGene("multi_resi", ("a", "b", "c", "d"))
    assert a.key == tp.StructuredGene("multi_resi", ("a", "d", "b", "c")).key and str(a).startswith("residual(a")


def test_panel_validation(spark):
    rows = [(dt.datetime(2024, 1, 1, 15), "A", 1.0), (dt.datetime(2024, 1, 2, 15), "B", float("nan"))]
    df = spark.createDataFrame(rows, f"{DATE} timestamp, {NAME} string, x double")
    assert validate_panel(df) and densify(df).count() == 4 and clean(df).where("x is null").count() == 1
    with pytest.raises(PanelError):
        validate_panel(df.unionByName(df))
    assert not validate_panel(df.withColumnRenamed("x", "y").drop(NAME), strict=False)


def test_residuals_of_many_controls(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=40)
    rows = [(dt.datetime(2024, 1, 1, 15), str(i), float(y[i]), *map(float, x[i])) for i in range(40)]
    df = spark.createDataFrame(rows, f"{DATE} timestamp, {NAME} string, y double, a double, b double, c double")
    got = np.array([r.residual for r in residuals(df, "y", ["a", "b", "c"], ridge=0.0).orderBy(F_id()).collect()])
    design = np.column_stack([np.ones(40), x])
    want = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose(got, want)


def F_id():
    from pyspark.sql import functions as F

    return F.col(NAME).cast("int")


def test_lasso_solver():
    g, r = np.eye(3), np.array([0.5, -0.05, 0.2])
    assert np.allclose(lasso.solve(g, r, 0.1), [0.4, 0.0, 0.1])


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1.0, 2.0)], "date string, A double, B double")
    assert {r[NAME] for r in tables.wide_to_long(df, "v").collect()} == {"A", "B"}
    a = spark.createDataFrame([(1, 1, 1.0)], f"{DATE} int, {NAME} int, x double")
    b = spark.createDataFrame([(1, 1, 2.0)], f"{DATE} int, {NAME} int, y double")
    assert tables.concat_last([a, b]).collect()[0]["y"] == 2.0
    tables.write_panel(a, str(tmp_path / "p"))
    assert tables.read_table(spark, str(tmp_path / "p"), "parquet").count() == 1
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.pkl")


def test_append_equals_full_history(spark):
    p = Program(call("ts_mean_5", field("x")))
    rows = [(dt.datetime(2024, 1, 1 + i, 15), c, float(i * k), True) for i in range(12) for k, c in ((1, "A"), (3, "B"))]
    df = spark.createDataFrame(rows, f"{DATE} timestamp, {NAME} string, x double, tradeable boolean")
    cut = dt.datetime(2024, 1, 11, 0)
    got = {(r[DATE], r[NAME]): r.factor for r in score_append(df.where(df[DATE] < cut), df.where(df[DATE] >= cut), p).collect()}
    assert got[(dt.datetime(2024, 1, 12, 15), "B")] == pytest.approx(27.0) and len(got) == 4
    late = df.where((df[NAME] == "A") | (df[DATE] >= cut))
    got = {(r[DATE].day, r[NAME]): r.factor for r in score_append(late.where(late[DATE] < cut), late.where(late[DATE] >= cut), p).collect()}
    assert got == {(11, "A"): pytest.approx(8.0), (12, "A"): pytest.approx(9.0), (11, "B"): None, (12, "B"): None}


@pytest.mark.parametrize("name", ["mt2_rank_ic_joint", "pl8_11_performance", "fp_deep", "ts14_selmean_5", "bh13_tree_slots", "jn8_asof_forward_fill", "ag1_daily_ticks", "se1_2_pareto_front"])
def test_second_engine(spark, name):
    got = q.queries()[name](spark, SF).toPandas()
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in ("nation", "customer", "supplier", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql((tq.oracle_sql() | {k: f(weekly_text()) for k, f in q.PANEL.items() if k == name})[name]).df()
    assert len(got) == len(want) and sorted(got.columns) == sorted(want.columns)
    key = [k for k in got.columns if got[k].dtype.kind != "f"]
    for k in got.columns:
        if got[k].dtype.kind == "f":
            a, b = (x.sort_values([*key, *[y for y in x.columns if y not in key]])[k].to_numpy(float) for x in (got, want))
            assert np.allclose(np.sort(a), np.sort(b), atol=2e-6, equal_nan=True)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_data_operators(tmp_path):
    """The driver removes the subpackage and its tests: the rest must still import and list its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for keep_pipeline in (True, False):
        copy = tmp_path / f"copy{keep_pipeline}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *[] if keep_pipeline else ["corpus_pipeline.py"]))
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and not any(k.startswith('op') or k == 'pipeline' for k in [*q, *o])"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, timeout=120)
