"""Months that a stopped run leaves, and co-occurrence of large groups."""

import datetime as dt
from collections import Counter
from itertools import product
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.operators import alignment as al
from quillon.plans.layers import DATE, NAME
from quillon.sources import chunks


def panel(spark, months=4):
    rows = [(dt.datetime(2024, m, d), n, float(m * d) if d % 5 else None) for m in range(1, months + 1) for d in range(1, 28) for n in "AB"]
    return spark.createDataFrame(rows, f"{DATE} timestamp, {NAME} string, v double")


def rows_of(df):
    return sorted(map(tuple, df.select(DATE, NAME, "v").collect()), key=repr)


def test_a_stopped_run_is_taken_up_again(spark, tmp_path, monkeypatch):
    path, df = f"file://{tmp_path}/p", panel(spark)
    put, calls = chunks._Store.put, []

    def stop(self, name, text):
        calls.append(name)
        if len(calls) == 3:
            raise KeyboardInterrupt  # the third month has been moved, but isn't named yet
        put(self, name, text)

    monkeypatch.setattr(chunks._Store, "put", stop)
    with pytest.raises(KeyboardInterrupt):
        chunks.write_chunks(df, path)
    monkeypatch.setattr(chunks._Store, "put", put)
    assert list(chunks.manifest(spark, path)) == ["202401", "202402"]
    assert rows_of(chunks.read_chunks(spark, path)) == rows_of(df.where(f"month({DATE}) <= 2"))
    assert chunks.write_chunks(df, path) == ["202403", "202404"]
    assert rows_of(chunks.read_chunks(spark, path, verify=True)) == rows_of(df)
    assert chunks.write_chunks(df, path) == [] and chunks.write_chunks(panel(spark, 5), path) == ["202405"]


def test_broken_months_are_told(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    chunks.write_chunks(panel(spark, 2), path)
    folder = Path(str(tmp_path), "p", chunks.manifest(spark, path)["202402"]["folder"])
    spark.read.parquet(f"file://{folder}").limit(5).write.mode("append").parquet(f"file://{folder}")
    with pytest.raises(chunks.BrokenChunk, match="202402"):
        chunks.read_chunks(spark, path, verify=True)
    with pytest.raises(FileNotFoundError):
        chunks.read_chunks(spark, f"file://{tmp_path}/none")
    with pytest.raises(Exception, match="without a date"):
        chunks.write_chunks(panel(spark, 1).withColumn(DATE, F.lit(None).cast("timestamp")), f"file://{tmp_path}/q")


def test_cooccurrence_of_a_large_group(spark):
    groups = {0: range(90), 1: range(80, 100), 2: [5, 5, 81], 3: [], 4: [7]}
    rows = [(g, i) for g, items in groups.items() for i in items] + [(1, None), (None, 3)]
    df = spark.createDataFrame(rows, "g int, i int")
    want = Counter(p for items in groups.values() for p in product(set(items), repeat=2))
    for size in (256, 7):
        got = al.cooccurrence(df, "g", "i", size)
        assert got.columns == ["a", "b", "n"] and {(r.a, r.b): r.n for r in got.collect()} == want
