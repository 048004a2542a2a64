"""Panels written month by month so that a run that stops can be taken up again.

Months are staged in one job, counted and digested as they lie there, moved to a folder of their own, and then named in
the manifest, which is one small file a month. That last step is a rename: a month is there whole or not at all, and what
a stopped run leaves behind is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.layers import DATE


class BrokenChunk(ValueError):
    """A month whose rows are not those that were written."""


class _Store:
    """The file system that ``path`` is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.top = path.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"can't move {old} to {new}")

    def put(self, name: str, text: str) -> None:
        """A small file under its name at once: written beside it and renamed."""
        beside = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(beside))
        out.write(bytearray(text.encode()))
        out.close()
        self.move(beside, name)

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _measures():
    """Rows and a digest that doesn't depend on their order."""
    return [F.count("*").alias("rows"), F.sum("_hash").cast("string").alias("digest")]


def _hashed(df: DataFrame) -> DataFrame:
    columns = sorted(c for c in df.columns if c != "ym")
    return df.select("ym", F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)").alias("_hash"))


def manifest(spark: SparkSession, path: str) -> dict[str, dict]:
    """{month: folder, rows, digest} of the months that are complete."""
    store = _Store(spark, path)
    if not store.fs.exists(store.path("_manifest")):
        return {}
    names = [s.getPath().getName() for s in store.fs.listStatus(store.path("_manifest"))]
    found = [n for n in names if n.endswith(".json") and not n.startswith(".")]
    if not found:
        return {}
    texts = spark.read.option("wholetext", True).text([f"{store.top}/_manifest/{n}" for n in found])
    records = [json.loads(r[0]) for r in texts.collect()]  # a row a month
    return {r["month"]: r for r in sorted(records, key=lambda r: r["month"])}


def write_chunks(df: DataFrame, path: str, date: str = DATE) -> list[str]:
    """Write the months of ``df`` that are not complete at ``path`` yet, and return them.

    Rows without a date are an error. The table is evaluated once.
    """
    spark = df.sparkSession
    store, run = _Store(spark, path), uuid.uuid4().hex
    there = list(manifest(spark, path))
    month = F.coalesce(F.date_format(date, "yyyyMM"), F.raise_error(F.lit("a row without a date")).cast("string"))
    new = df.withColumn("ym", month)
    new = new.where(~F.col("ym").isin(there)) if there else new
    stage = f"_staging/{run}"
    new.write.option("compression", "zstd").partitionBy("ym").parquet(f"{store.top}/{stage}")
    out = []
    if any(s.getPath().getName().startswith("ym=") for s in store.fs.listStatus(store.path(stage))):
        staged = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).schema(new.schema).parquet(f"{store.top}/{stage}")
        for r in _hashed(staged).groupBy("ym").agg(*_measures()).orderBy("ym").collect():  # a row a month
            folder = f"ym={r['ym']}/{run}"
            store.move(f"{stage}/ym={r['ym']}", folder)
            store.put(f"_manifest/{r['ym']}.json", json.dumps({"month": r["ym"], "folder": folder, "rows": r["rows"], "digest": r["digest"]}))
            out.append(r["ym"])
    store.drop(stage)
    return out


def read_chunks(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """All complete months. ``verify`` counts and digests them again and raises BrokenChunk where a month isn't what was written."""
    known = manifest(spark, path)
    if not known:
        raise FileNotFoundError(f"no complete month at {path}")
    top = path.rstrip("/")
    d = spark.read.option("mergeSchema", True).parquet(*[f"{top}/{r['folder']}" for r in known.values()])
    if verify:
        parts = [_hashed(spark.read.parquet(f"{top}/{r['folder']}").withColumn("ym", F.lit(m))) for m, r in known.items()]
        every = parts[0]
        for x in parts[1:]:
            every = every.unionByName(x)
        got = {r["ym"]: (r["rows"], r["digest"]) for r in every.groupBy("ym").agg(*_measures()).collect()}
        broken = [m for m, r in known.items() if got.get(m) != (r["rows"], r["digest"])]
        if broken:
            raise BrokenChunk(f"months {', '.join(broken)} are not as written")
    return d
