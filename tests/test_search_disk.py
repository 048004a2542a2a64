from quillon.functions import time_series as ts
from quillon.operators import evolve as ev
from quillon.plans.layers import DATE, NAME, SparkPanel
from quillon.plans.storage import without_shuffles


def _table(spark):
    rows = [(f"2020-01-{1 + k % 9:02d}", k // 9, float(k * 7 % 5) if k % 4 else None, float(k * 11 % 17), k % 6 > 0) for k in range(180)]
    return spark.createDataFrame(rows, f"{DATE} string, {NAME} int, x double, y double, tradeable boolean").selectExpr(f"CAST({DATE} AS timestamp) AS {DATE}", NAME, "x", "y", "tradeable")


def _shuffles(spark):
    """Blocks of exchanges on the disks of this process."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b.name() for b in (blocks.apply(i) for i in range(blocks.size())) if b.name().startswith("shuffle_")}


def test_exchanges_of_a_batch_leave_the_disk(spark):
    """what each batch of a search had exchanged stayed until the driver collected garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before, there = spark.conf.get(key, None), _shuffles(spark)
    kind = ev.Kind(lambda: "x", lambda a: "x", lambda p, g: ts.ts_mean(p, g, 2), lambda g: g)
    scores = ev.score_batch(SparkPanel(_table(spark)), kind, ["x", "y"], "y")
    assert all(s.days for s in scores) and _shuffles(spark) <= there and spark.conf.get(key, None) == set_before
    with without_shuffles(spark):
        assert spark.conf.get(key) == "true"
    spark.range(10).repartition(3).count()
    assert _shuffles(spark) - there
