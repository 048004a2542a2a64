"""Operator 11: embedding whitening by hierarchical merging of singular value decompositions.

Every partition of the vectors becomes a summary: how many they are, their exact sums, and the singular values times right
singular vectors of what is left around their mean. Summaries merge by stacking these factors, appending for each one a
row that corrects for the difference of means, and decomposing again. No dimension is ever cut, so the summary at the top
of the tree is that of all vectors at once. A summary has d x d numbers however many vectors it stands for.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import configure, materialise

#: Scaled components beyond this size count as this size, so that sums of a batch stay exact in 64 bits.
LARGEST = 1 << 50
#: Bytes of factors that one merge gathers at most, and summaries that it merges at most.
MERGE_BYTES, FAN_IN = 64 << 20, 16
#: Singular values below this part of the largest are those of directions in which nothing varies.
RANK_TOLERANCE = 1e-10
STATE = "slot long, n long, sums string, factor binary"


@dataclass(frozen=True)
class Summary:
    """Of ``n`` vectors: their sums (exact where they are integers), and a factor whose ``factor.T @ factor`` is their scatter about their mean."""

    n: int
    sums: np.ndarray
    factor: np.ndarray


def decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors, all of them."""
    if not len(rows):
        return rows
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def summarise(x: np.ndarray) -> Summary:
    """The summary of the rows of ``x``; integers keep exact sums, as Python's whole numbers."""
    away = (x - x[0]).astype(np.float64)  # exact for integers, and small
    sums = x.sum(0).astype(object) if x.dtype.kind == "i" else x.sum(0)
    return Summary(len(x), sums, decomposed(away - away.mean(0)))


def merge(parts: Iterable[Summary]) -> Summary:
    """The summary of all vectors of ``parts`` (one at least)."""
    parts = iter(parts)
    first = next(parts)
    n, sums, rows = first.n, first.sums, [first.factor]
    for p in parts:
        apart = ((sums * p.n - p.sums * n) / (n * p.n)).astype(np.float64)
        rows += [p.factor, math.sqrt(n / (n + p.n) * p.n) * apart[None, :]]
        n, sums = n + p.n, sums + p.sums
    return Summary(n, sums, first.factor if len(rows) == 1 else decomposed(np.concatenate(rows)))


def packed(slots: list[int], parts: list[Summary]) -> dict:
    return {
        "slot": pa.array(slots, pa.int64()),
        "n": pa.array([p.n for p in parts], pa.int64()),
        "sums": pa.array([json.dumps(p.sums.tolist()) for p in parts], pa.string()),
        "factor": pa.array([np.ascontiguousarray(p.factor).tobytes() for p in parts], pa.binary()),
    }


def unpacked(row: dict) -> Summary:
    sums = json.loads(row["sums"])
    whole = all(isinstance(s, int) for s in sums)
    return Summary(row["n"], np.array(sums, object if whole else np.float64), np.frombuffer(row["factor"], np.float64).reshape(-1, len(sums)))


def matrix(column, kind) -> np.ndarray:
    """A list column without nulls and of equal lengths as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def summary_of(vectors: DataFrame, column: str, width: int, whole: bool) -> Summary | None:
    """The summary of all rows of ``column`` (arrays of ``width`` numbers), merged in a tree; None without rows.

    Partitions write theirs to the shared folder, and each level of the tree merges at most FAN_IN of them in a task. The
    one at the top comes to the driver: it has ``width`` x ``width`` numbers.
    """
    kind, step = (np.int64 if whole else np.float64), max(256, 4 * width)

    def leaves(batches):
        held: list[Summary] = []
        for batch in batches:
            x = matrix(batch.column(0), kind)
            for i in range(0, len(x), step):
                held.append(summarise(x[i : i + step]))
                if len(held) >= 8:
                    held = [merge(held)]
        if held:
            yield pa.RecordBatch.from_pydict(packed([TaskContext.get().partitionId()], [merge(held)]))

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["slot"])
        return pa.table(packed([rows[0]["slot"] // fan], [merge(unpacked(r) for r in rows)]))

    fan = max(2, min(FAN_IN, MERGE_BYTES // (8 * width * width)))
    parts = materialise(vectors.select(column).mapInArrow(leaves, STATE), "summaries")
    last = parts.agg(F.max("slot")).first()[0]
    if last is None:
        return None
    while last > 0:
        parts = parts.groupBy(F.floor(F.col("slot") / fan)).applyInArrow(merged, STATE)
        last //= fan
    return unpacked(parts.first().asDict())


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors and their sums; unit ``directions`` (columns) of falling variance, those variances, and the total."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: 64-bit where that holds it, else Python's whole numbers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def deviations(self, apart: np.ndarray) -> list[int | None]:
        """Sums of squares, exact; None where 64 bits don't hold one."""
        most = int(np.abs(apart).max(initial=0))
        if apart.dtype != object and most * most * apart.shape[1] < 1 << 63:
            return (apart * apart).sum(1).tolist()
        sums = (apart.astype(object) ** 2).sum(1)
        return [int(s) if s < 1 << 63 else None for s in sums]

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart.astype(np.float64) / self.n) @ self.directions / np.sqrt(self.variances)


def whitening(top: Summary, components: int) -> Whitening:
    """The first ``components`` directions in which anything varies; each has its largest entry positive."""
    _, s, vt = np.linalg.svd(top.factor, full_matrices=False)
    keep = np.flatnonzero(s > RANK_TOLERANCE * s[0])[:components] if len(s) and s[0] > 0 else np.zeros(0, int)
    v = vt[keep]
    v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1.0, 1.0)[:, None] if len(v) else v
    return Whitening(top.n, top.sums, v.T, s[keep] ** 2 / top.n, float((s**2).sum() / top.n))


def scaled(vectors: DataFrame, scale: int, id_col: str) -> DataFrame:
    """(vec_id, x): rows whose vector has no null and no non-finite entry, as floor(scale * c)."""
    c = F.col("embedding").cast("array<double>")
    odd = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = vectors.select(F.col(id_col).alias("vec_id"), c.alias("c")).where(c.isNotNull() & ~F.coalesce(odd, F.lit(True)))
    most = F.lit(float(LARGEST))
    whole = F.transform("c", lambda e: F.floor(F.greatest(F.least(e * scale, most), -most)).cast("long"))
    return good.select("vec_id", whole.alias("x"))


def apply_whitening(rows: DataFrame, model: Whitening, identity_error: float) -> DataFrame:
    """One row per vector of ``rows`` (vec_id, x) and component."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        k = len(m.variances)
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            apart = m.apart(matrix(batch.column(1), np.int64))
            size = batch.num_rows
            at = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(at),
                "component": pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()),
                "n": pa.array(np.full(size * k, m.n), pa.int64()),
                "deviation": pa.array(m.deviations(apart), pa.int64()).take(at),
                "whitened": pa.array(m.whitened(apart).ravel(), pa.float64()),
                "explained": pa.array(np.tile(m.variances / m.total, size), pa.float64()),
                "identity_error": pa.array(np.full(size * k, identity_error), pa.float64()),
            })

    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema)


def embedding_whitening(vectors: DataFrame, components: int = 16, scale: int = 64, id_col: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Vectors that are null or hold null or non-finite entries are left out. The others are taken as whole numbers
    floor(scale * c), and the whitening is fitted on each distinct one of them once: ``n`` is their number, ``deviation``
    the exact sum of (n * x - sums)^2 (null where 64 bits don't hold it), ``whitened`` the projection of x less the mean
    on a component of unit length, over its standard deviation, ``explained`` that component's part of the variance.
    ``identity_error`` is measured in a second pass: the largest entry of the whitened vectors' covariance, less the
    identity. Adding the same number to all entries changes none of these.

    Components in which nothing varies are not returned: there are fewer of them where the distinct vectors span less, and
    no row at all where there is one distinct vector only. Vectors of different length are spaces of their own, each
    fitted and whitened by itself; empty vectors have no component. Rows with a null or a repeated id are rows like
    others; repeated vectors weigh once. Equal variances have any directions that span their space. An empty table gives
    no rows. Only ``id_col`` and ``embedding`` are read, so other columns' names can't clash.
    """
    spark = vectors.sparkSession
    configure(spark)
    rows = scaled(vectors, scale, id_col)
    distinct = materialise(rows.select("x").distinct(), "distinct")
    out = []
    for r in sorted(distinct.groupBy(F.size("x").alias("d")).count().where("d > 0").collect()):
        d = r["d"]
        own = F.size("x") == d
        top = summary_of(distinct.where(own), "x", d, whole=True)
        model = whitening(top, components)
        out.append(apply_whitening(rows.where(own), model, identity_error(distinct.where(own), model)))
    if not out:
        return apply_whitening(rows.limit(0), whitening(Summary(1, np.zeros(1, object), np.zeros((0, 1))), 0), 0.0)
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened ``distinct`` vectors, less the identity; by the same tree of summaries."""
    k = len(model.variances)
    if not k:
        return 0.0
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                w = shared.value.whitened(shared.value.apart(matrix(batch.column(0), np.int64)))
                offsets = pa.array(np.arange(0, w.size + 1, k), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64()))], names=["w"])

    white = summary_of(distinct.select("x").mapInArrow(run, "w array<double>"), "w", k, whole=False)
    return float(np.abs(white.factor.T @ white.factor / white.n - np.eye(k)).max())
