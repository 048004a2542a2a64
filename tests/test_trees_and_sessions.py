"""Nodes of JSON texts, and session statistics merged from parts, against plain versions."""

import datetime as dt
import json

import numpy as np
import pytest

from quillon.operators import json_tree, orderbook, results
from quillon.plans.layers import DATE, NAME


def test_walk_of_a_text():
    text = '{"a \\"b\\"": [1.50, {"op": "x"}, null, true], "op": "{\\"op\\": \\"no\\"}", "op": ""}'
    got = list(json_tree.walk(text))
    assert got == [
        (0, None, 0, None, None, "object", None),
        (1, 0, 1, 'a "b"', None, "array", None),
        (2, 1, 2, None, 0, "number", "1.50"),
        (3, 1, 2, None, 1, "object", None),
        (4, 3, 3, "op", None, "string", "x"),
        (5, 1, 2, None, 2, "null", None),
        (6, 1, 2, None, 3, "boolean", "true"),
        (7, 0, 1, "op", None, "string", '{"op": "no"}'),
        (8, 0, 1, "op", None, "string", ""),
    ]
    assert [list(json_tree.walk(x)) for x in (None, "", "{", "NaN", "[" * 100_000)] == [[]] * 5 and len(list(json_tree.walk("[]"))) == 1
    deep = json.dumps([[[[1]]]])
    assert [n[2] for n in json_tree.walk(deep)] == [0, 1, 2, 3, 4]


def test_usage_of_programs(spark):
    program = {"op": 'say "add"', "note": '"op": "no"', "args": [{"field": "x"}, {"field": "x"}, {"op": "neg", "field": 3}]}
    df = spark.createDataFrame([(1, json.dumps(program), "c"), (2, "no json", "c"), (None, None, "c"), (3, '{"op": "neg"}', "c")], "gene long, program_json string, name string")
    got = {tuple(r) for r in results.program_usage(df, "gene").collect()}
    assert got == {(1, "operator", 'say "add"', 1), (1, "operator", "neg", 1), (1, "field", "x", 2), (3, "operator", "neg", 1)}
    assert json_tree.json_nodes(df.limit(0), "program_json", ["gene"]).count() == 0


def plain(v):
    """Statistics of values in order of time."""
    v = np.array([x for x in v if x is not None], float)
    n = len(v)
    if not n:
        return {k: None for k in ("mean", "std", "skew", "last", "max", "min")}
    skew = None
    if n > 2:
        m2 = ((v - v.mean()) ** 2).mean()
        skew = ((v - v.mean()) ** 3).mean() / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2) if m2 > 1e-20 else 0.0
    return {"mean": v.mean(), "std": v.std(ddof=1) if n > 1 else None, "skew": skew, "last": v[-1], "max": v.max(), "min": v.min()}


def test_sessions_that_overlap(spark):
    r = np.random.default_rng(0)
    parts = {"full": ("00:00", "23:59"), "morning": ("09:30", "11:30"), "noon": ("11:00", "13:00"), "minute": ("11:15", "11:15"), "never": ("03:00", "03:10")}
    rows = []
    for day, n in ((1, 200), (2, 3), (3, 1)):
        for name in "AB":
            for k, m in enumerate(sorted(r.choice(600, n, replace=False).tolist())):
                at = dt.datetime(2024, 1, day, 9) + dt.timedelta(minutes=m, seconds=k % 60)
                rows.append((at, name, None if r.random() < 0.1 else float(r.normal() * 1e-3 + 1e4), 5.0, None))
    df = spark.createDataFrame(rows, f"{DATE} timestamp, {NAME} string, u double, same double, none double").repartition(5)
    got = {(x[DATE].day, x[NAME]): x.asDict() for x in orderbook.daily_book(df, ["u", "same", "none"], parts).collect()}
    assert len(got) == 6
    for (day, name), row in got.items():
        own = sorted(x for x in rows if x[0].day == day and x[1] == name)
        for s, (lo, hi) in parts.items():
            inside = [x for x in own if lo <= x[0].strftime("%H:%M") <= hi]
            for j, m in ((2, "u"), (3, "same"), (4, "none")):
                for k, want in plain([x[j] for x in inside]).items():
                    have = row[f"{m}_{s}_{k}"]
                    assert (have is None) == (want is None), (m, s, k)
                    assert want is None or have == pytest.approx(want, rel=1e-6, abs=1e-3 if k == "skew" else 1e-9), (m, s, k)
