import datetime as dt

import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pytest

from quillon.sources.batches import RecordBatches, read_batches, write_batches
from quillon.sources.tables import read_table


@pytest.fixture()
def frame():
    return pd.DataFrame({
        "Datetime": pd.date_range("2020-01-01 15:00", periods=1000, freq="D"), "Contract": pd.Series([f"c{i % 7}" for i in range(1000)], dtype="category"),
        "x": [None if i % 5 == 0 else i / 3 for i in range(1000)], "n": range(1000), "name": ["é中" * (i % 3) for i in range(1000)],
    })


def test_file_of_many_batches(spark, frame, tmp_path):
    path = str(tmp_path / "f.feather")
    pyarrow.feather.write_feather(frame, path, chunksize=64)
    d = read_batches(spark, path, task_bytes=1)
    assert d.rdd.getNumPartitions() == 16  # 1000 / 64
    assert dict(d.dtypes) == {"Datetime": "timestamp", "Contract": "string", "x": "double", "n": "bigint", "name": "string"}
    got = d.toPandas().sort_values("n").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, frame.astype({"Contract": str}), check_dtype=False)
    assert read_table(spark, path).count() == 1000


def test_wanted_columns_in_any_order(spark, frame, tmp_path):
    path = str(tmp_path / "f.feather")
    pyarrow.feather.write_feather(frame, path, chunksize=300)
    d = read_batches(spark, path, ["name", "n"])
    assert d.columns == ["name", "n"]
    assert sorted(map(tuple, d.collect()), key=lambda r: r[1]) == list(zip(frame["name"], frame["n"], strict=True))


def test_round_trip_with_nulls_and_nested(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, None, dt.datetime(2020, 3, 29, 2, 30), [1.0, None]), (2, "", None, None), (None, "a", dt.datetime(1969, 12, 31), [])]
    d = spark.createDataFrame(rows, "k long, s string, at timestamp, v array<double>")
    write_batches(d, path)
    assert sorted(map(str, read_batches(spark, path).collect())) == sorted(map(str, d.collect()))
    write_batches(d, path)
    assert read_batches(spark, path).count() == 6
    write_batches(d.where("k = 1"), path, "overwrite")
    assert [r.k for r in read_batches(spark, path).collect()] == [1]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    write_batches(spark.range(5), path)
    with pytest.raises(Exception, match="nine"):
        write_batches(spark.range(0, 20, 1, 4).selectExpr("IF(id = 9, raise_error('nine'), id) AS id"), path)
    assert read_batches(spark, path).count() == 5
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_")]


def test_odd_files(spark, frame, tmp_path):
    with pytest.raises(Exception, match="nothing"):
        read_batches(spark, str(tmp_path / "nothing.feather"))
    pyarrow.feather.write_feather(frame.astype({"Contract": str}), str(tmp_path / "old.feather"), version=1)
    with pytest.raises(Exception, match="(?i)arrow"):
        read_batches(spark, str(tmp_path / "old.feather"))
    pyarrow.feather.write_feather(frame[:0], str(tmp_path / "empty.feather"))
    assert read_batches(spark, str(tmp_path / "empty.feather")).count() == 0
    folder = tmp_path / "two"
    folder.mkdir()
    pyarrow.feather.write_feather(pa.table({"a": [1], "b": [2]}), str(folder / "1.feather"))
    pyarrow.feather.write_feather(pa.table({"a": [3]}), str(folder / "2.feather"))
    with pytest.raises(Exception, match="has no"):
        read_batches(spark, str(folder)).collect()
    assert sorted(r.a for r in read_batches(spark, str(folder), ["a"]).collect()) == [1, 3]


def test_partitions_cover_a_file_once(frame, tmp_path):
    path = str(tmp_path / "f.feather")
    pyarrow.feather.write_feather(frame, path, chunksize=64, compression="uncompressed")
    reader = RecordBatches({"path": path, "task_bytes": "10000"}).reader(None)
    parts = reader.partitions()
    assert len(parts) > 3
    assert [i for p in parts for i in range(p.first, p.after)] == list(range(16))
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 1000
