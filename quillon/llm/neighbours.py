"""Operator 7: near-duplicate embeddings by product quantisation.

Unit vectors are indexed by coarse inverted lists with residual subspace codes, fitted on a bounded sample; every vector is
indexed. A vector is looked up in each list whose border with its own list is near enough: as near as links of the sample,
found by brute force, and the spread of the vectors across that border ask for, and never farther than a link can reach.
In a list, asymmetric distances from lookup tables, widened by each code's known error, leave out only what cannot be a
link; the rest is decided by the exact cosine in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import components, configure, materialise

#: Vectors the index is fitted on at most, those of lowest hashed id; members a list should have; most lists.
SAMPLE, LIST_SIZE, MOST_LISTS = 16000, 200, 1024
SUBSPACES, CODES = 16, 64
TILE_MEMBERS, TILE_QUERIES = 512, 1024
#: Vectors of the sample whose links with the rest of it are found by brute force; by how much the farthest of those is exceeded; and how many deviations across a border are reached at least.
TRIAL_QUERIES, TRIAL_FACTOR, DEVIATIONS = 4096, 1.2, 3.0


@dataclass(frozen=True)
class ProductIndex:
    """Coarse centres, for each subspace (a range of dimensions) its codewords for residuals, and for each two lists how far across their border links reach, as a difference of squared distances to their centres."""

    centres: np.ndarray
    cuts: np.ndarray
    books: tuple[np.ndarray, ...]
    reach: np.ndarray

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what they miss)."""
        codes, missed = np.empty((len(residual), len(self.books)), np.uint8), np.zeros(len(residual))
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            d = distances(part, book)
            codes[:, m] = d.argmin(1)
            missed += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(missed)

    def lookup(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of residuals (queries) to coded residuals, from one table per subspace."""
        out = np.zeros((len(residual), len(codes)))
        for m, book in enumerate(self.books):
            out += distances(residual[:, self.cuts[m] : self.cuts[m + 1]], book)[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


    def finds(self, x: np.ndarray, y: np.ndarray, home: int) -> np.ndarray:
        """For pairs of vectors (rows of x and y), whether y, at home in list ``home``, is looked up in the list of x."""
        of_x = distances(x, self.centres).argmin(1)
        own = ((y - self.centres[home]) ** 2).sum(1)
        return ((y - self.centres[of_x]) ** 2).sum(1) - own <= self.reach[home, of_x] + 1e-9

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home list of each vector, which lists it is looked up in)."""
        d = distances(x, self.centres)
        home = d.argmin(1)
        return home, d - d[np.arange(len(x)), home][:, None] <= self.reach[home] + 1e-9


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = np.concatenate([distances(x[i : i + 4000], c).argmin(1) for i in range(0, len(x), 4000)])
        n = np.bincount(a, minlength=k)
        for j in range(x.shape[1]):
            s = np.bincount(a, x[:, j], k)
            c[:, j] = np.where(n > 0, s / np.maximum(n, 1), c[:, j])
    return c


def farthest(centres: np.ndarray, threshold: float) -> np.ndarray:
    """For each two lists, the reach within which no link can be missed."""
    return 2 * float(np.sqrt(2 - 2 * threshold)) * np.sqrt(distances(centres, centres))


def reaches(unit: np.ndarray, centres: np.ndarray, home: np.ndarray, threshold: float) -> np.ndarray:
    """For each two lists, how much nearer to its own centre than to the other a vector may be that is still looked up there.

    Going from a vector to one within the radius of a link changes the difference of its squared distances to two centres by
    2 * radius * |between them| at most, and by that only straight across the border. So this is the farthest reach. Links
    that go in any direction of the space reach a small part of it, links of vectors that vary in few directions much more:
    the part is taken from the sample, as DEVIATIONS of its vectors' spread across the border over their whole spread, and
    as TRIAL_FACTOR times the largest part that any link of TRIAL_QUERIES of them needs.
    """
    radius = float(np.sqrt(2 - 2 * threshold))
    between = np.sqrt(distances(centres, centres))
    r = unit - centres[home]
    c = r.T @ r
    spread = np.diag(centres @ c @ centres.T)
    across = np.maximum(spread[:, None] + spread[None, :] - 2 * centres @ c @ centres.T, 0)
    part = DEVIATIONS * np.sqrt(across / np.maximum(between**2 * max(np.trace(c), 1e-12), 1e-12))
    most = 0.0
    for i in range(0, min(TRIAL_QUERIES, len(unit)), 256):
        q = np.arange(i, min(i + 256, TRIAL_QUERIES, len(unit)))
        a, b = np.nonzero(unit[q] @ unit.T >= threshold)
        a = q[a]
        other = home[a] != home[b]
        a, b = a[other], b[other]
        if len(a):
            x, hx, hy = unit[a], home[a], home[b]
            gap = ((x - centres[hy]) ** 2).sum(1) - ((x - centres[hx]) ** 2).sum(1)
            most = max(most, float((gap / np.maximum(2 * radius * between[hx, hy], 1e-12)).max()))
    return 2 * radius * between * np.minimum(1.0, np.maximum(part, TRIAL_FACTOR * most))


def fit_index(unit: np.ndarray, lists: int, threshold: float = 0.95, seed: int = 5, exact: bool = False) -> ProductIndex:
    """Fit on unit vectors; fewer vectors than lists or codes make fewer of them. ``exact``: every list is looked up that a link can be in."""
    rng = np.random.default_rng(seed)
    centres = kmeans(unit, max(1, min(lists, len(unit))), 10, rng)
    home = np.concatenate([np.zeros(0, np.int64), *[distances(unit[i : i + 4000], centres).argmin(1) for i in range(0, len(unit), 4000)]])
    residual = unit - centres[home]
    residual = residual[rng.choice(len(residual), min(len(residual), 4000), replace=False)]
    dims = unit.shape[1]
    cuts = np.linspace(0, dims, min(SUBSPACES, dims) + 1).round().astype(int)
    books = tuple(kmeans(residual[:, a:b], min(CODES, len(residual)), 6, rng) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    return ProductIndex(centres, cuts, books, farthest(centres, threshold) if exact else reaches(unit, centres, home, threshold))


def matrix(column) -> np.ndarray:
    """A list<float> or list<double> column of equal lengths as doubles."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(a.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def entries(classes: DataFrame, index: ProductIndex) -> DataFrame:
    """(list, query, rep, mult, codes, missed, v): each vector as a member of its list and as a query of all lists it probes."""
    shared = classes.sparkSession.sparkContext.broadcast(index)
    stored = dict(classes.dtypes)["embedding"]
    kind = pa.list_(pa.float64() if stored == "array<double>" else pa.float32())

    def run(batches):
        ix = shared.value
        for batch in batches:
            x = unit_rows(matrix(batch.column(2)))
            if not len(x):
                continue
            home, probes = ix.probes(x)
            codes, missed = ix.encode(x - ix.centres[home])
            q, lists = np.nonzero(probes)
            raw = batch.column(2)
            at = np.concatenate([np.arange(len(x)), q])
            n = len(x)
            yield pa.RecordBatch.from_pydict(
                {
                    "list": pa.array(np.concatenate([home, lists]), pa.int32()),
                    "query": pa.array(np.arange(len(at)) >= n),
                    "rep": batch.column(0).take(pa.array(at)),
                    "mult": batch.column(1).take(pa.array(at)),
                    "codes": pa.array([c.tobytes() for c in codes] + [None] * len(q), pa.binary()),
                    "missed": pa.array(np.concatenate([missed, np.zeros(len(q))]), pa.float64()),
                    "v": raw.take(pa.array(at)).cast(kind),
                }
            )

    return classes.select("rep", "mult", "embedding").mapInArrow(run, f"list int, query boolean, rep long, mult long, codes binary, missed double, v {stored}")


def list_links(index: ProductIndex, centre: np.ndarray, codes: np.ndarray, missed: np.ndarray, members: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, cosine) of pairs of one list with an exact cosine of ``threshold`` or more."""
    radius = np.sqrt(2 - 2 * threshold) + 1e-6
    q, y = unit_rows(queries), unit_rows(members)
    i, j = np.nonzero(index.lookup(q - centre, codes) <= radius + missed[None, :])
    keep_i, keep_j, keep_c = [], [], []
    for a in range(0, len(i), 50_000):
        ii, jj = i[a : a + 50_000], j[a : a + 50_000]
        c = np.einsum("ij,ij->i", q[ii], y[jj])
        ok = c >= threshold
        keep_i.append(ii[ok])
        keep_j.append(jj[ok])
        keep_c.append(c[ok])
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *keep_i]), np.concatenate([z, *keep_j]), np.concatenate([np.zeros(0), *keep_c])


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with edges (a, b): pairs (smallest id of the tree, id)."""
    ids, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = back[: len(a)], back[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for k in (i, j, root[i], root[j]):
            np.minimum.at(new, k, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[at]], ids[at]


def search(found: DataFrame, index: ProductIndex, threshold: float) -> DataFrame:
    """(a, b, links): spanning edges (links null), and for each vector a with links in a tile their number (b null).

    A pair found in a list counts for the vector looked up; where the other one is not looked up in the first one's list,
    so that the link shows from one side only, it counts for both. Lists are cut into tiles of bounded numbers of members and queries, so that a list with a third of all vectors is many
    tasks; a tile sees every member and query of its part.
    """
    shared = found.sparkSession.sparkContext.broadcast(index)
    sizes = found.groupBy("list").agg(F.ceil(F.sum((~F.col("query")).cast("int")) / TILE_MEMBERS).cast("int").alias("across"), F.ceil(F.sum(F.col("query").cast("int")) / TILE_QUERIES).cast("int").alias("down"))
    # At most MOST_LISTS rows.
    tiles = found.join(F.broadcast(sizes), "list").where("across > 0")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("query"), F.col("down")).otherwise(F.col("across"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("across")).otherwise(F.col("down")) - 1))
    tiles = tiles.withColumn("own", own).withColumn("other", other)
    tile = F.when(F.col("query"), F.struct(F.col("other").alias("x"), F.col("own").alias("y"))).otherwise(F.struct(F.col("own").alias("x"), F.col("other").alias("y")))
    tiles = tiles.withColumn("t", F.xxhash64("list", tile["x"], tile["y"])).select("t", "list", "query", "rep", "mult", "codes", "missed", "v")

    def run(table: pa.Table) -> pa.Table:
        ix = shared.value
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        rep, mult = table.column("rep").to_numpy(), table.column("mult").to_numpy()
        lists = table.column("list").to_numpy()
        v = matrix(table.column("v"))
        a, b, links, who = [], [], [], []
        for k in np.unique(lists):
            m, q = np.flatnonzero(~query & (lists == k)), np.flatnonzero(query & (lists == k))
            if not len(m) or not len(q):
                continue
            codes = np.frombuffer(b"".join(table.column("codes")[int(x)].as_py() for x in m), np.uint8).reshape(len(m), -1)
            i, j, _ = list_links(ix, ix.centres[k], codes, table.column("missed").to_numpy()[m], v[m], v[q], threshold)
            i, j = q[i], m[j]
            other = rep[i] != rep[j]
            i, j = i[other], j[other]
            x, y = spanning(rep[i], rep[j])
            n = np.bincount(i, mult[j], len(rep))
            if len(i):
                once = ~np.concatenate([ix.finds(unit_rows(v[i[c : c + 20_000]]), unit_rows(v[j[c : c + 20_000]]), k) for c in range(0, len(i), 20_000)])
                n += np.bincount(j[once], mult[i[once]], len(rep))
            n = n.astype(np.int64)
            a.append(x)
            b.append(y)
            who.append(rep[n > 0])
            links.append(n[n > 0])
        z = np.zeros(0, np.int64)
        a, b, who, links = (np.concatenate([z, *x]) for x in (a, b, who, links))
        return pa.table({"a": pa.array(np.concatenate([a, who]), pa.int64()), "b": pa.array([*b.tolist(), *[None] * len(who)], pa.int64()), "links": pa.array([*[None] * len(a), *links.tolist()], pa.int64())})

    return tiles.groupBy("t").applyInArrow(run, "a long, b long, links long")


def embedding_components(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector.

    n_links counts the other vectors found with cosine >= ``threshold`` (equal vectors among them), component_id is the
    smallest id reachable by links, kept marks it. Vectors that are null or zero, or hold null or non-finite components,
    link with nothing, as do rows without an id, which are kept; vectors of different length don't link. Equal vectors are
    looked up once. An empty table gives no rows. Cosines are taken in double precision, of components as they are stored:
    floats as floats, anything else as doubles. Ties need no rule, as all links of a vector count. Of other columns only
    ``id_col`` and ``embedding`` are read, so their names can't clash. ``exact`` looks every vector up in all lists that
    a link of it can be in, which finds all links and takes several times as long.
    """
    spark = vectors.sparkSession
    configure(spark)
    stored = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    vectors = vectors.select(F.col(id_col), F.col("embedding"))
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = x.isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(x, lambda e: e != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(good, F.lit(False)).alias("good"), F.col("embedding").cast(stored).alias("embedding"))
    rows = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), F.reverse("embedding"), F.size("embedding")))
    classes = rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.min_by("embedding", "vec_id").alias("embedding"))
    classes = materialise(classes, "vectors")
    results = []
    for r in sorted(classes.groupBy(F.size("embedding").alias("d")).count().collect()):
        same = classes.where(F.size("embedding") == r["d"])
        picked = same.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()
        index = fit_index(unit_rows(matrix(picked.column(0))), min(MOST_LISTS, -(-r["count"] // LIST_SIZE)), threshold, exact=exact)
        found = materialise(entries(same, index), "lists")
        results.append(search(found, index, threshold))
    named = classes.select("k1", "k2", "rep", "mult")
    if results:
        every = results[0]
        for x in results[1:]:
            every = every.unionByName(x)
        every = materialise(every, "links")
        counts = every.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
        tree = components(every.where("links is null").select("a", "b")).withColumnRenamed("node", "rep")
        named = named.join(counts, "rep", "left").join(tree, "rep", "left")
    else:
        named = named.withColumns({"links": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    named = named.select("k1", "k2", F.lit(True).alias("good"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "k1", "k2", "good").join(named, ["k1", "k2", "good"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
