"""Operator 12: centroid clustering by dual-tree Lloyd rounds.

Vectors are cut into shards where they are read, and each shard's cover tree is built once and written. A round builds a
cover tree over the centroids and walks both trees at once: a pair of nodes goes when even its nearest vectors are farther
apart than some centroid is from all of the vectors' node. Pairs of leaves are compared exactly, in whole numbers. What a
round brings together is each cluster's count and sums, so nothing that grows with the vectors leaves the tasks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import configure, materialise

#: Scaled components beyond this size count as this size, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Vectors of one tree at most; vectors a node keeps without children; pairs of vectors compared at a time.
SHARD, LEAF, PAIRS = 1024, 16, 65536
SHARD_ROW = "ids array<{kind}>, points binary, centre binary, radius binary, first binary, last binary, low binary, high binary"
ARRAYS = {"centre": np.int32, "radius": np.float64, "first": np.int32, "last": np.int32, "low": np.int32, "high": np.int32}


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``a`` to the same rows of ``b``, exact."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


@dataclass(frozen=True)
class CoverTree:
    """Points in the order of the leaves, and nodes: the point at the centre, the farthest of the node's points from it, those points as a range first:last, and its children as a range low:high of nodes (empty for a leaf)."""

    points: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[CoverTree, np.ndarray]:
    """(tree, order of the points): a node's children lie within its radius, half of which is the reach of each; their centres are farther apart than that.

    A node of ``leaf`` points or fewer, or of equal ones, has no children; one point is always its own node's centre.
    """
    todo, nodes = [(0, np.arange(len(x)), np.sqrt(squared(x, x[:1]).astype(np.float64)))], []
    at = 0
    while at < len(todo):
        centre, members, far = todo[at]
        at += 1
        radius = float(far.max())
        if len(members) <= leaf or radius == 0:
            nodes.append((centre, radius, members, 0, 0))
            continue
        low, half = len(todo), radius / 2
        near = far <= half
        todo.append((centre, members[near], far[near]))
        rest = members[~near]
        while len(rest):
            d = np.sqrt(squared(x[rest], x[rest[:1]]).astype(np.float64))
            inside = d <= half
            todo.append((rest[0], rest[inside], d[inside]))
            rest = rest[~inside]
        nodes.append((centre, radius, None, low, len(todo)))
    # Points in the order of a walk over the leaves: then those below any node are one range.
    first, last, order = np.zeros(len(nodes), np.int32), np.zeros(len(nodes), np.int32), []
    size, stack = 0, [(0, False)]
    while stack:
        k, left = stack.pop()
        _, _, members, low, high = nodes[k]
        if left:
            last[k] = size
            continue
        first[k] = size
        if members is not None:
            order.append(members)
            size += len(members)
            last[k] = size
        else:
            stack.append((k, True))
            stack += [(c, False) for c in range(high - 1, low - 1, -1)]
    order = np.concatenate(order)
    place = np.empty(len(x), np.int32)
    place[order] = np.arange(len(x))
    low, high = np.array([n[3] for n in nodes], np.int32), np.array([n[4] for n in nodes], np.int32)
    return CoverTree(x[order], place[[n[0] for n in nodes]], np.array([n[1] for n in nodes]), first, last, low, high), order


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number within it) for ``counts`` items each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def nearest(vectors: CoverTree, centroids: CoverTree, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid of each point, squared distance, pairs of points compared); ``number`` has the centroids' numbers by their place in the tree, and ties go to the smaller.

    The dual walk. A centroid stands at the centre of each node of its tree, so every point of a node of vectors has one
    within the distance of the centres plus its own radius: that bounds what the node's other pairs are worth, and its
    children's.
    """
    qx, cx = vectors.points[vectors.centre], centroids.points[centroids.centre]
    bound = np.full(len(qx), np.inf)
    q, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(q):
        d = np.concatenate([np.sqrt(squared(qx[q[i : i + PAIRS]], cx[c[i : i + PAIRS]]).astype(np.float64)) for i in range(0, len(q), PAIRS)])
        np.minimum.at(bound, q, d + vectors.radius[q])
        # A little more than rounding can make of it is kept.
        keep = d - vectors.radius[q] - centroids.radius[c] <= bound[q] * (1 + 1e-9) + 1e-6
        q, c = q[keep], c[keep]
        q_leaf, c_leaf = vectors.high[q] == 0, centroids.high[c] == 0
        both = q_leaf & c_leaf
        leaves.append((q[both], c[both]))
        split_c = ~both & ~c_leaf & (q_leaf | (centroids.radius[c] >= vectors.radius[q]))
        split_q = ~both & ~split_c
        a, k = spread((centroids.high - centroids.low)[c[split_c]])
        b, m = spread((vectors.high - vectors.low)[q[split_q]])
        parent, child = q[split_q][b], vectors.low[q[split_q]][b] + m
        np.minimum.at(bound, child, bound[parent])
        q, c = np.concatenate([q[split_c][a], child]), np.concatenate([centroids.low[c[split_c]][a] + k, c[split_q][b]])
    q, c = np.concatenate([x for x, _ in leaves]), np.concatenate([x for _, x in leaves])
    best = np.full(len(vectors.points), np.iinfo(np.int64).max)
    who = np.full(len(vectors.points), np.iinfo(np.int64).max)
    wide, compared = (vectors.last - vectors.first)[q].astype(np.int64) * (centroids.last - centroids.first)[c], 0
    cuts = np.flatnonzero(np.diff(np.cumsum(wide) // PAIRS, prepend=0)) if len(wide) else []
    for i, j in zip([0, *cuts], [*cuts, len(q)], strict=True):
        which, k = spread(wide[i:j])
        qq, cc = q[i:j][which], c[i:j][which]
        across = (centroids.last - centroids.first)[cc]
        p, s = vectors.first[qq] + k // across, centroids.first[cc] + k % across
        d = squared(vectors.points[p], centroids.points[s])
        compared += len(d)
        n = number[s]
        order = np.lexsort((n, d, p))
        p, d, n = p[order], d[order], n[order]
        head = np.flatnonzero(np.diff(p, prepend=-1))
        p, d, n = p[head], d[head], n[head]
        better = (d < best[p]) | ((d == best[p]) & (n < who[p]))
        best[p[better]], who[p[better]] = d[better], n[better]
    return who, best, compared


def scaled(vectors: DataFrame, scale: int, width: int, id_col: str) -> DataFrame:
    """(vec_id, x): vectors of exactly ``width`` entries, none null or non-finite, as floor(scale * c)."""
    c = F.col("embedding").cast("array<double>")
    odd = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = vectors.select(F.col(id_col).alias("vec_id"), c.alias("c")).where((F.size(c) == width) & ~F.coalesce(odd, F.lit(True)))
    most = F.lit(float(LARGEST))
    return good.select("vec_id", F.transform("c", lambda e: F.floor(F.greatest(F.least(e * scale, most), -most)).cast("int")).alias("x"))


def rows_of(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def shards(vectors: DataFrame) -> DataFrame:
    """One row per cover tree over at most SHARD vectors of one partition, as they come; no exchange."""
    kind = dict(vectors.dtypes)["vec_id"]

    def packed(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        tree, order = cover_tree(x)
        ids = ids.take(pa.array(order))
        columns = {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "points": pa.array([tree.points.astype(np.int32).tobytes()], pa.binary())}
        return pa.RecordBatch.from_pydict(columns | {k: pa.array([getattr(tree, k).astype(t).tobytes()], pa.binary()) for k, t in ARRAYS.items()})

    def run(batches):
        ids, x, held = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, SHARD):
                part = batch.slice(i, SHARD)
                if held + part.num_rows > SHARD:
                    yield packed(pa.concat_arrays(ids), np.concatenate(x))
                    ids, x, held = [], [], 0
                ids.append(part.column(0))
                x.append(rows_of(part.column(1)))
                held += part.num_rows
        if held:
            yield packed(pa.concat_arrays(ids), np.concatenate(x))

    return vectors.mapInArrow(run, SHARD_ROW.format(kind=kind))


def trees(batches, width: int):
    """(ids, tree) of each row of ``shards``."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw = {k: batch.column(j)[i].as_buffer() for j, k in enumerate(["points", *ARRAYS], 1)}
            arrays = {k: np.frombuffer(raw[k], t) for k, t in ARRAYS.items()}
            yield batch.column(0)[i].values, CoverTree(np.frombuffer(raw["points"], np.int32).astype(np.int64).reshape(-1, width), **arrays)


def cluster_sums(stored: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, sums by component)} with every vector assigned to its nearest of ``centroids``."""
    shared = stored.sparkSession.sparkContext.broadcast(centroids)
    width = centroids.shape[1]

    def run(batches):
        own, number = cover_tree(shared.value, leaf=4)
        n, sums = np.zeros(len(number), np.int64), np.zeros((len(number), width), np.int64)
        for _, tree in trees(batches, width):
            who, _, _ = nearest(tree, own, number)
            order = np.argsort(who, kind="stable")
            heads = np.flatnonzero(np.diff(who[order], prepend=-1))
            sums[who[order][heads]] += np.add.reduceat(tree.points[order], heads)
            n += np.bincount(who, minlength=len(n))
        full = np.flatnonzero(n)
        # A cluster's count goes with its sums, as the component after the last.
        values = np.concatenate([sums[full], n[full, None]], axis=1)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.repeat(full, width + 1), pa.int32()), "at": pa.array(np.tile(np.arange(width + 1), len(full)), pa.int32()), "v": pa.array(values.ravel(), pa.int64())})

    rows = stored.mapInArrow(run, "cluster int, at int, v long").groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[int, list[int]] = {}
    for r in rows.collect():  # centroids x (components + 1) numbers
        out.setdefault(r["cluster"], [0] * (width + 1))[r["at"]] = int(r["v"])
    return {k: (v[-1], v[:-1]) for k, v in out.items()}


def seeds(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors whose id has the smallest SHA-256, in that order; equal ids go by their vectors, null ids are never seeds."""
    key = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where("vec_id is not null").orderBy(key, "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, width: int = 64, prefix: str = "2:", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row per vector of ``width`` finite entries.

    Entries count as floor(scale * c), so all arithmetic is exact and no result depends on how vectors are partitioned.
    Ties go to the smaller cluster; a cluster left empty keeps its centroid. There are fewer clusters where there are
    fewer vectors with an id; equal seeds leave all but the first of them empty. Vectors that are null, of another length,
    or hold null or non-finite entries get no row; neither does any where no vector has an id. Rows with a null or a
    repeated id are vectors like others. Inertias that 64 bits don't hold are null. An empty table gives no rows. Only
    ``id_col`` and ``embedding`` are read, so other columns' names can't clash. ``k`` x ``width`` numbers are held by the
    driver and every task.
    """
    spark = vectors.sparkSession
    configure(spark)
    rows = scaled(vectors, scale, width, id_col)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, cluster int, distance long"
    start = seeds(rows, k, prefix)
    if not len(start):
        none = F.lit(None).cast("long")
        return spark.createDataFrame([], schema).select("*", none.alias("cluster_inertia"), none.alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    stored = materialise(shards(rows), "trees")
    centroids = start
    for _ in range(rounds):
        moved = centroids.copy()
        for j, (n, sums) in cluster_sums(stored, centroids).items():
            moved[j] = [s // n for s in sums]
        centroids = moved
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches):
        own, number = cover_tree(shared.value, leaf=4)
        for ids, tree in trees(batches, shared.value.shape[1]):
            who, d, _ = nearest(tree, own, number)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(who, pa.int32()), "distance": pa.array(d, pa.int64())})

    assigned = materialise(stored.mapInArrow(run, schema), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(total.alias("s")).collect()}  # one row per cluster
    whole = sum(sums.values())
    fits = lambda v: v if v < 1 << 63 else None
    named = [(j, fits(sums[j]), fits(whole), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j in sorted(sums)]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
