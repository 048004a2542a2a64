"""Session settings, shared storage and connected components used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python stay near this many bytes, however long single texts are.
ARROW_BATCH_BYTES = 8 << 20


def configure(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; row counts alone would let long texts exhaust a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir`` of the session, or the checkpoint folder set on its context.

    A local master, whose executors are this process, may go without and gets a temporary folder. Any other master must
    name one: files in a folder of one machine would be missing on the others.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext.getCheckpointDir()
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, conf.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and lost executors only reread files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession, size: float, each: float, per_partition: int = 2) -> int:
    """Hash buckets for a packed exchange of about ``size`` bytes: at most about ``each`` bytes in one, and a few for each shuffle partition at least."""
    return max(64, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, component) with component the smallest node.

    Alternating large-star and small-star rounds; every round is two grouped minima and two joins, so no vertex's
    neighbourhood is gathered anywhere and the edge list never reaches the driver. Null ends and loops are ignored;
    nodes without an edge do not appear. An empty edge table gives an empty result.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialise(e, "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()

    seen = state(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Minima are written before they are joined: the join then has exchanges of its own, of which a hub's part can be split.
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        low = materialise(large.groupBy("b").agg(F.min("a").alias("m")), "low")
        joined = large.join(low, "b")
        small = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(joined.select(F.col("m").alias("x"), F.col("b").alias("y")))
        e = materialise(small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
