"""Readers and writers of panels and result tables."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.layers import DATE, NAME
from quillon.plans.panel import BLOCK, NAMES, VALUES, in_blocks, validate_panel
from quillon.plans.storage import written
from quillon.sources.batches import read_batches


def read_table(spark: SparkSession, path: str, kind: str | None = None, encoding: str = "UTF-8", schema: str | None = None) -> DataFrame:
    """A table by its suffix or ``kind``: parquet, csv or feather. Pickles are refused, as reading them runs code.

    A csv without a ``schema`` is read once more to infer one. Feather files are read batch by batch, in tasks.
    """
    kind = (kind or path.rsplit(".", 1)[-1]).lower()
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind == "csv":
        reader = spark.read.option("header", True).option("encoding", encoding)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if kind in ("feather", "ipc", "arrow"):
        return read_batches(spark, path)
    raise ValueError(f"can't read {kind!r}")


def read_panel(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A panel: a table whose keys are there, typed, never null and unique. Rows are in no order; windows sort what they need."""
    d = read_table(spark, path, kind)
    validate_panel(d)
    return d


def read_results(spark: SparkSession, path: str, encodings: Sequence[str] = ("UTF-8", "GBK")) -> DataFrame:
    """A table of search results. Of csv files the first encoding is taken in which every text can be read; a byte order mark is dropped.

    Spark reads few encodings, so the file is read byte by byte and its texts are decoded in batches.
    """
    if not path.endswith(".csv"):
        return read_table(spark, path)
    raw = spark.read.option("header", True).option("inferSchema", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    texts = [i for i, (_, t) in enumerate(raw.dtypes) if t == "string"]
    for e in encodings:
        try:
            names = [c.encode("latin-1").decode(e).lstrip("\ufeff") for c in raw.columns]
        except UnicodeDecodeError:
            continue
        numbered = raw.toDF(*[f"c{i}" for i in range(len(names))])

        def read(parts, e=e):
            for d in parts:
                for i in texts:
                    d[f"c{i}"] = d[f"c{i}"].map(lambda v: v if v is None else v.encode("latin-1").decode(e, "replace"))
                yield d

        d = numbered.mapInPandas(read, numbered.schema)
        broken = [F.col(f"c{i}").contains("\ufffd") for i in texts]
        if not broken or d.where(reduce(lambda a, b: a | b, broken)).isEmpty():
            return d.toDF(*names)
    raise ValueError(f"{path} is in none of {', '.join(encodings)}")


def read_ticks(spark: SparkSession, path: str, fields: Sequence[str], start: str, end: str, date: str = DATE) -> DataFrame:
    """Keys and fields of an external tick store between two days, both included; the bounds reach the scan."""
    at = F.col(date)
    return spark.read.parquet(path).where((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))).select(date, NAME, *fields)


def read_parts(spark: SparkSession, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All files of a pattern as one panel: columns that some lack are missing there, and of rows with one key the one of the last file by name stays."""
    d = spark.read.option("mergeSchema", True).parquet(pattern)
    keep = [c for c in d.columns if columns is None or c in (DATE, NAME, *columns)]
    w = Window.partitionBy(DATE, NAME).orderBy(F.col("_file").desc())
    return d.select(*keep, F.input_file_name().alias("_file")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_file")


#: Contracts that a wide table has as columns; of more it is rows of blocks, each of at most about so many contracts.
MOST_COLUMNS = 1000


def wide_to_long(df: DataFrame, value: str, date: str | None = None) -> DataFrame:
    """Rows (Datetime, Contract, value) of a table with a column per contract, or of one in blocks; missing cells stay."""
    names = {c.lower(): c for c in df.columns}
    date = date or next((names[k] for k in ("datetime", "date", "trade_date", "time") if k in names), None)
    if date is None:
        raise ValueError("no date column")
    df = df.withColumnRenamed(date, DATE)
    if in_blocks(df):
        return df.select(DATE, F.explode(F.arrays_zip(F.col(NAMES).alias("n"), F.col(VALUES).alias("v"))).alias("cell")).select(DATE, F.col("cell.n").alias(NAME), F.col("cell.v").alias(value))
    return df.unpivot(DATE, [c for c in df.columns if c != DATE], NAME, value)


def long_to_wide(df: DataFrame, value: str, most: int = MOST_COLUMNS) -> DataFrame:
    """A column per contract. A plan can't have tens of thousands of columns, so a table of more than ``most`` contracts is
    rows of blocks instead: by date and block the names of its contracts, in order, and their values, missing ones included."""
    df = written(df.select(DATE, NAME, value), "long")  # read several times
    contracts = df.select(NAME).distinct().count()
    if contracts <= most:
        return df.groupBy(DATE).pivot(NAME).agg(F.first(value))
    # Contracts are named as a pivot names its columns.
    cells = df.select(DATE, F.coalesce(F.col(NAME).cast("string"), F.lit("null")).alias(NAME), F.col(value).alias(VALUES)).groupBy(DATE, NAME).agg(F.first(VALUES).alias(VALUES))
    blocks = -(-contracts // most)
    names = df.select(F.coalesce(F.col(NAME).cast("string"), F.lit("null")).alias("_name")).distinct()
    grid = names.crossJoin(F.broadcast(df.select(F.col(DATE).alias("_date")).distinct()))
    full = grid.join(cells, F.col("_date").eqNullSafe(F.col(DATE)) & (F.col("_name") == F.col(NAME)), "left")
    rows = full.groupBy(F.col("_date").alias(DATE), F.pmod(F.xxhash64("_name"), F.lit(blocks)).cast("int").alias(BLOCK))
    held = rows.agg(F.sort_array(F.collect_list(F.struct(F.col("_name").alias("n"), F.col(VALUES).alias("v")))).alias("_cells"))
    return held.select(DATE, BLOCK, F.col("_cells.n").alias(NAMES), F.col("_cells.v").alias(VALUES))


def factor_table(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Keys and numeric columns, renamed with a prefix."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    keep = [c for c, t in df.dtypes if t in kinds and c not in (DATE, NAME, *exclude) and (not include or c in include)]
    return df.select(DATE, NAME, *[F.col(c).alias(prefix + c) for c in keep])


def concat_last(parts: Sequence[DataFrame], keys: Sequence[str] = (DATE, NAME)) -> DataFrame:
    """Tables one after another, missing columns allowed; of rows with one key that of the last table stays."""
    out = None
    for i, d in enumerate(parts):
        d = d.withColumn("_i", F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_i").desc())
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_i", "_n")


def write_panel(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A panel as zstd parquet or csv."""
    writer = df.write.mode("overwrite")
    writer.option("compression", "zstd").parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)


def month_ranges(start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """First and last day of each month between two days, both included."""
    out, cur = [], start
    while cur <= end:
        following = (cur.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
        out.append((cur, min(end, following - dt.timedelta(days=1))))
        cur = following
    return out


def write_months(df: DataFrame, path: str, skip_existing: bool = False) -> None:
    """A panel partitioned by month; months in ``df`` are replaced, others stay. ``skip_existing`` leaves months alone that are there already, so that a run can be taken up again."""
    if skip_existing:
        try:
            there = df.sparkSession.read.parquet(path).select(F.col("ym").cast("string")).distinct()
            df = df.join(F.broadcast(there.withColumnRenamed("ym", "_there")), F.date_format(DATE, "yyyyMM") == F.col("_there"), "left_anti")  # a row a month
        except AnalysisException:
            pass
    df.withColumn("ym", F.date_format(DATE, "yyyyMM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(path)


def write_results(results: DataFrame, config: dict, path: str) -> None:
    """A search's ranked rows as one csv file, and its settings as JSON next to it."""
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/results")
    results.sparkSession.createDataFrame([(json.dumps(config, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def write_built(panel: DataFrame, profile: DataFrame, metadata: dict, path: str) -> None:
    """A panel as zstd parquet, its profile as csv and its metadata as JSON."""
    write_panel(panel, f"{path}/panel")
    profile.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/coverage")
    panel.sparkSession.createDataFrame([(json.dumps(metadata, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_rules(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_rules(rules: dict, path: str) -> None:
    Path(path).write_text(json.dumps(rules, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
