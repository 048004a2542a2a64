from quillon.plans.panel import weekly_panel


def test_panel_is_one_exchange(spark):
    """order lines were exchanged by week and supplier, and their sums again by supplier."""
    plan = weekly_panel(spark, "/root/testdata/sf0.001").frame([])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange hashpartitioning(l_suppkey") == 1
