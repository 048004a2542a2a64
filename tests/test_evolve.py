"""The search over any kind of candidate: scores against numpy, errors, closure, validation in the direction found."""

import datetime as dt

import numpy as np
import pytest

from quillon.operators import evolve as ev
from quillon.plans.layers import DATE, NAME, SparkPanel
from quillon.plans.rules import FieldRule, Sampler
from quillon.plans.templates import StructuredGene, check_behaviour

RULES = {"a": FieldRule(kind="pv_volume"), "b": FieldRule(kind="pv_momentum"), "c": FieldRule("turnover", kind="pv_volume")}
CUT = f"{DATE} < TIMESTAMP '2024-01-09'"


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(12):
        for k in range(8):
            a, b, c = (float(x) for x in r.normal(size=3))
            rows.append((dt.datetime(2024, 1, 1 + i), f"n{k}", "x" if k % 2 else "y", True, a, b, c, -a + 0.3 * b, abs(c)))
    names = f"{DATE} timestamp, {NAME} string, industry string, tradeable boolean, a double, b double, c double, label double, size double"
    return SparkPanel(spark.createDataFrame(rows, names))


def single(f):
    return StructuredGene("single", (f,), ("current",))


def rank_ics(panel, f):
    df = panel.base.toPandas()
    return df.groupby(DATE).apply(lambda g: g[f].rank().corr(g["label"].rank()))


def test_scores_equal_numpy(panel):
    kind = ev.structured_kind(Sampler(RULES))
    ics = rank_ics(panel, "a")
    early = ics[ics.index < "2024-01-09"]
    s, t = ev.score_all(panel, kind, [single("a"), single("b")], 1, where=CUT)
    assert s.ic == pytest.approx(early.mean()) and s.ir == pytest.approx(abs(early.mean()) / early.std()) and s.days == 8
    assert s.direction == -1 and s.win == pytest.approx((early < 0).mean()) and s.coverage == 1
    turned = ev.score_batch(panel, kind, [single("a")], where=CUT, directions=[1])[0]
    assert turned.direction == 1 and turned.ir == pytest.approx(-s.ir) and not ev.Criteria().passed(turned) and ev.Criteria().passed(s)


def test_one_bad_candidate_spoils_no_other(panel):
    def build(p, g):
        if g == "unknown":
            raise ValueError("no such candidate")
        return p.let("no_such_column + 1") if g == "broken" else g

    kind = ev.Kind(lambda: "a", lambda alive: "b", build, lambda g: g)
    got = ev.score_batch(panel, kind, ["a", "broken", "unknown", "b"])
    assert [bool(s.error) for s in got] == [False, True, True, False] and got[0].ic == pytest.approx(rank_ics(panel, "a").mean())
    assert ev.score_batch(panel, kind, []) == []


@pytest.mark.parametrize("trees", [False, True])
def test_behaviour_breeding_is_closed_and_seeded(trees):
    def line(seed):
        s = Sampler(RULES, seed)
        genes = [s.behaviour(trees=trees) for _ in range(30)]
        return genes + [s.mutate_behaviour(g, trees) for g in genes] + [s.cross_behaviour(a, b) for a in genes[:8] for b in genes]

    genes = line(3)
    assert not any(check_behaviour(g) for g in genes) and [g.key for g in genes] == [g.key for g in line(3)]
    assert sum(a.key != b.key for a, b in zip(genes[:30], genes[30:60], strict=True)) > 20


def test_evolve_and_validate(panel):
    kind = ev.structured_kind(Sampler(RULES))
    found = ev.evolve(panel, kind, ev.Sizes(5, 1, 4), where=CUT)
    assert found and [e.front for e in found] == sorted(e.front for e in found) and len({kind.key(e.candidate) for e in found}) == len(found)
    checked = ev.validate(panel, kind, found, where=f"NOT ({CUT})")
    signs = {kind.key(e.candidate): e.score.direction for e in found}
    assert all(e.score.direction == signs[kind.key(e.candidate)] for e, _ in checked) and {kind.key(e.candidate) for e, _ in checked} == set(signs)
