"""Legality of expressions, and closure of the samplers under mutation and crossing."""

import pytest

from quillon.plans import rules as ru
from quillon.plans.templates import MODE_FIELDS, MODES, StructuredGene, Tree, check_behaviour

NAMES = ["net_profit", "gross_profit", "operating_profit", "revenue_ttm", "total_assets", "fixed_assets", "market_cap", "enterprise_value", "roe", "profit_growth", "earnings_yield", "rating_score", "ret_5d"]
RULES = ru.infer_rules(NAMES)


def test_inference():
    assert RULES["market_cap"].group == "market_value" and RULES["earnings_yield"].family == "valuation" and "diff_1y" in RULES["net_profit"].transforms
    assert ru.infer_rules(["xyz"])["xyz"] == ru.FieldRule()


@pytest.mark.parametrize(
    ("gene", "fine"),
    [
        (StructuredGene("ratio", ("net_profit", "market_cap"), ("current", "current")), True),
        (StructuredGene("ratio", ("market_cap", "net_profit"), ("current", "current")), False),
        (StructuredGene("ratio", ("net_profit", "net_profit"), ("current", "current")), False),
        (StructuredGene("pair_ratio", ("net_profit", "operating_profit", "total_assets", "fixed_assets"), ("current",) * 4), True),
        (StructuredGene("pair_ratio", ("net_profit", "revenue_ttm", "total_assets", "fixed_assets"), ("current",) * 4), False),
        (StructuredGene("resi", ("roe", "ret_5d"), ("zscore", "current")), True),
        (StructuredGene("resi_pair", ("roe", "net_profit", "operating_profit"), ("zscore", "diff_1y", "diff_1y")), True),
        (StructuredGene("resi_pair", ("net_profit", "net_profit", "operating_profit"), ("current",) * 3), False),
        (StructuredGene("style_composite", ("roe", "earnings_yield"), ("current", "current")), True),
        (StructuredGene("style_composite", ("roe", "ret_5d"), ("current", "current")), False),
        (StructuredGene("single", ("net_profit",), ("current",)), False),
        (StructuredGene("nothing", ("roe",)), False),
    ],
)
def test_structured_legality(gene, fine):
    assert (not ru.check_structured(gene, RULES)) == fine


def test_samplers_are_closed_and_seeded():
    s = ru.Sampler(RULES)
    for mode in MODE_FIELDS:
        a, b = s.structured(mode), s.structured(mode)
        for g in (a, b, s.mutate(a), s.cross(a, b)):
            assert not ru.check_structured(g, RULES)
    for mode in MODES:
        for trees in (False, True):
            assert not check_behaviour(s.behaviour(mode, trees))
    assert ru.Sampler(RULES, 5).structured() == ru.Sampler(RULES, 5).structured()


def test_tree_rules():
    leaf = lambda x: Tree("", leaf=x)
    assert not ru.check_tree(Tree("mean", (leaf("roe"), leaf("profit_growth"))), RULES)
    assert ru.check_tree(Tree("interaction", (leaf("roe"), leaf("profit_growth"))), RULES)
    assert ru.check_tree(Tree("mean", (leaf("roe"), leaf("roe"))), RULES) and ru.check_tree(Tree("mean", (leaf("roe"), leaf("ret_5d"))), RULES)
    assert len(ru.ACROSS_KINDS) * 2 == 32 and len(ru.KIND_FAMILY) == 17
