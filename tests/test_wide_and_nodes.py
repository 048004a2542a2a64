import datetime as dt

from pyspark.sql import functions as F

from quillon.library_queries import QUERIES
from quillon.operators.json_tree import json_nodes
from quillon.plans.panel import BLOCK, in_blocks, validate_wide
from quillon.sources import tables


def test_parents_names_need_no_join(spark):
    texts = ['{"a": {"b": [1, {"c": null}]}, "a": 2}', None, "[[3]]", "{", '"x"', '{"": {"d": true}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "k int, t string")
    plain, named = json_nodes(df, "t", ["k"]), json_nodes(df, "t", ["k"], parents=True)
    name = {(r.k, r.node): r.name for r in plain.collect()}
    got = named.collect()
    assert sorted(map(str, named.drop("parent_name").collect())) == sorted(map(str, plain.collect()))
    assert [r.parent_name for r in got] == [None if r.parent is None else name[r.k, r.parent] for r in got] and "b" in [r.parent_name for r in got]
    plan = QUERIES["ag6_program_nodes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_wide_tables_of_more_contracts_than_columns(spark):
    at = lambda d, h=15: dt.datetime(2020, 1, d, h)
    rows = [(at(1 + k % 5), k // 5 % 23, float(k) if k % 7 else None) for k in range(115) if k % 11]
    df = spark.createDataFrame(rows, "Datetime timestamp, Contract long, v double")
    columns, blocks = tables.long_to_wide(df, "v"), tables.long_to_wide(df, "v", most=6)
    assert len(columns.columns) == 24 and in_blocks(blocks) and blocks.select(BLOCK).distinct().count() == 4
    order = ["Datetime", "Contract"]
    want, got = (tables.wide_to_long(w, "v") for w in (columns, blocks))
    assert want.dtypes == got.dtypes and want.orderBy(order).collect() == got.orderBy(order).collect() and got.count() == 115
    assert validate_wide(blocks) and not validate_wide(blocks.unionByName(blocks), False)
    assert not validate_wide(blocks.withColumn("Datetime", F.date_trunc("day", "Datetime")), False)
    one = blocks.where("_block = 0 AND Datetime > '2020-01-02'").unionByName(blocks.where("_block <> 0"))
    assert not validate_wide(one, False)
    assert not validate_wide(blocks.withColumn("_values", F.col("_values").cast("array<string>")), False)
    assert not validate_wide(blocks.withColumn("_names", F.transform("_names", lambda n: F.lit("1"))), False)
    undated = df.unionByName(df.limit(3).withColumn("Datetime", F.lit(None).cast("timestamp")))
    assert not validate_wide(tables.long_to_wide(undated, "v"), False) and not validate_wide(tables.long_to_wide(undated, "v", most=6), False)
