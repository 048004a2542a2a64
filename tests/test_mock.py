"""Made-up panels: shape, calendar, planted signal, and the same cells however they are made."""

from quillon.plans.layers import DATE, NAME
from quillon.plans.panel import validate_panel
from quillon.sources.mock import MockShape, mock_panel


def test_mock_panel(spark):
    df = mock_panel(spark, MockShape(dates=90, contracts=30))
    assert validate_panel(df)
    x = df.toPandas()
    assert len(x) == 2700 and (x[DATE].dt.weekday < 5).all() and (x[DATE].dt.hour == 15).all() and x[DATE].nunique() == 90
    ic = x.dropna(subset=["label"]).groupby(DATE)[["imbalance", "flow_large", "label"]].apply(lambda g: g.rank().corr()["label"]).mean()
    assert ic["imbalance"] > 0.3 and abs(ic["flow_large"]) < 0.1
    late = x.sort_values(DATE).groupby(NAME)["profit_growth"]
    assert (late.apply(lambda g: g.isna().sum()) == 20).all() and (late.nunique() == 2).all()


def test_mock_panel_does_not_depend_on_partitions_or_contracts(spark):
    small = mock_panel(spark, MockShape(dates=20, contracts=5)).toPandas()
    large = mock_panel(spark, MockShape(dates=20, contracts=9)).repartition(7).toPandas()
    both = small.merge(large, on=[DATE, NAME])
    assert len(both) == 100
    assert all((both[f"{c}_x"].fillna(-1) == both[f"{c}_y"].fillna(-1)).all() for c in ("price", "volume", "label", "tradeable", "size"))
