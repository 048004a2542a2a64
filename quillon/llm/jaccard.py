"""Operator 8: n-gram Jaccard join with several global orders.

A document is its set of distinct word shingles. Two sets can only be alike enough if their prefixes, taken under any
global order of the shingles, share one; here that must hold under three orders at once before a pair is verified.
All orders put rare shingles first, which needs every shingle's document frequency, counted over all documents.

1. Each document's shingles go, packed as sorted arrays, to hash ranges; a range counts documents and keeps shingles of
   two or more. A shingle of one document can be in no intersection, so only its number still matters.
2. The kept shingles return to their documents. A document whose whole prefix is unique links with nothing and is done.
   The few that remain hold all that verification needs: their size and their shared shingles.
3. They are dealt to blocks of bounded size around the most central document they share a prefix shingle with, and
   blocks are paired where a prefix shingle is in both. A pair of blocks is decided in one small task: length bound,
   positional bound and prefix sharing under every order, and exact overlap of what is left, as matrix products.
   It returns a spanning forest of its links.
4. Connected components of the forests.

Exact copies are one class from the start. No pair of documents is ever a row, and no group is gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as T
from quillon.llm.common import buckets, components, configure, materialise

_WORDS = T.classes("space")
_DOC_BITS = np.uint64(12)
BLOCK = 64
ORDERS = 3
#: Bytes of packed shingles in one hash range, about.
RANGE_BYTES = 6 << 20


@dataclass(frozen=True)
class Rule:
    """Words in a shingle, and the least similarity as a fraction of integers."""

    words: int = 5
    above: int = 80
    below: int = 100

    def need(self, n):
        """The least overlap a set of size n must have with any partner: ceil(n * above / below)."""
        return -(-n * self.above // self.below)


def shingle_sets(b: np.ndarray, o: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text << 52 | 52-bit shingle) of at most 4096 texts, sorted, and the bounds of each text in it."""
    s, e, bounds = T.tokens(b, o, _WORDS)
    h = T.hashes(b, s, e)
    g, at = T.runs(h, bounds, words)
    doc = np.repeat(np.arange(len(o) - 1), np.diff(bounds))[at]
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < words))
    if len(short):
        g = np.concatenate([g, np.array([T.folded(h[bounds[i] : bounds[i + 1]]) for i in short], np.uint64)])
        doc = np.concatenate([doc, short])
    key = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (g >> _DOC_BITS))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key, np.searchsorted(key, np.arange(len(o), dtype=np.uint64) << np.uint64(52))


def fingerprints(key: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each text's set, whatever its order."""
    x = key & np.uint64((1 << 52) - 1)
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(T.mix(x * np.uint64(2) + np.uint64(salt))))
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out[0], out[1]


def set_keys(docs: DataFrame, rule: Rule, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, k1, k2): the size and fingerprint of each document's set."""
    at = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            n, one, two = [], [], []
            for _, _, bb, oo in T.blocks(*T.strings(batch.column(1))):
                key, bounds = shingle_sets(bb, oo, rule.words)
                a, c = fingerprints(key, bounds)
                n.append(np.diff(bounds))
                one.append(a.view(np.int64))
                two.append(c.view(np.int64))
            z = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate(z + x), pa.int64()) for x in (n, one, two)]], names=["doc_id", "n_shingles", "k1", "k2"])

    return at.mapInArrow(run, at.select("doc_id").schema.add("n_shingles", "long").add("k1", "long").add("k2", "long"))


def scatter(docs: DataFrame, rule: Rule, ranges: int) -> DataFrame:
    """(r, docs, tokens): for every block of documents and hash range, the sorted shingles in it and whose they are.

    Of texts with equal sets, a task sends the first only; others can add no link between different texts.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        edges = (np.arange(1, ranges, dtype=object) * (1 << 52) // ranges).astype(np.uint64) << _DOC_BITS
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, bb, oo in T.blocks(*T.strings(batch.column(1))):
                key, bounds = shingle_sets(bb, oo, rule.words)
                one, two = fingerprints(key, bounds)
                new = np.zeros(j - i, bool)
                for k in np.flatnonzero(np.diff(bounds)):
                    name = int(one[k]), int(two[k])
                    new[k] = name not in seen
                    seen.add(name)
                doc = key >> np.uint64(52)
                pick = new[doc.astype(np.int64)]
                key = np.sort((key[pick] << _DOC_BITS) | doc[pick])
                who = ids[i:j][(key & np.uint64(0xFFF)).astype(np.int64)]
                tok = key >> _DOC_BITS
                cut = np.concatenate([[0], np.searchsorted(key, edges), [len(key)]])
                at = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict({"r": pa.array(at, pa.int32()), "docs": pa.array([T.planes(who[cut[k] : cut[k + 1]]) for k in at], pa.binary()), "tokens": pa.array([T.planes(tok[cut[k] : cut[k + 1]]) for k in at], pa.binary())})

    return docs.mapInArrow(run, "r int, docs binary, tokens binary")


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    parts = [T.unplanes(x.as_py(), kind) for x in table.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def gather_shared(scattered: DataFrame, homes: int) -> DataFrame:
    """(q, docs, tokens, df): shingles of two or more documents, packed by the documents' home ``doc_id mod homes``."""

    def run(table: pa.Table) -> pa.Table:
        who, tok = _joined(table, "docs", np.int64), _joined(table, "tokens", np.uint64)
        order = np.argsort(tok, kind="stable")
        tok, who = tok[order], who[order]
        first = np.append(True, tok[1:] != tok[:-1])
        start = np.flatnonzero(first)
        df = np.diff(np.append(start, len(tok)))
        pick = np.repeat(df > 1, df)
        df, tok, who = np.repeat(df, df)[pick], tok[pick], who[pick]
        order = np.lexsort((who, tok))
        df, tok, who = df[order], tok[order], who[order]
        # One id in two tasks (a repeated row) counts once.
        same = np.append(False, (tok[1:] == tok[:-1]) & (who[1:] == who[:-1])) if len(tok) else np.zeros(0, bool)
        df, tok, who = df[~same], tok[~same], who[~same]
        home = np.mod(who, homes)
        order = np.argsort(home, kind="stable")
        df, tok, who, home = df[order].astype(np.uint32), tok[order], who[order], home[order]
        start = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.zeros(0, np.int64)
        cut = np.append(start, len(home))
        part = lambda a: pa.array([T.planes(a[cut[k] : cut[k + 1]]) for k in range(len(start))], pa.binary())
        return pa.table({"q": pa.array(home[start], pa.int32()), "docs": part(who), "tokens": part(tok), "df": part(df)})

    return scattered.groupBy("r").applyInArrow(run, "q int, docs binary, tokens binary, df binary")


def survivors(shared: DataFrame, keys: DataFrame, rule: Rule, homes: int) -> DataFrame:
    """(doc_id, n, tokens, df): documents whose prefix holds a shared shingle, with all their shared shingles."""
    sizes = keys.where("n_shingles > 0 and doc_id is not null").select(F.pmod("doc_id", F.lit(homes)).cast("int").alias("q"), "doc_id", F.col("n_shingles").alias("n"))

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        who, tok, df = _joined(table, "docs", np.int64), _joined(table, "tokens", np.uint64), _joined(table, "df", np.uint32)
        order = np.lexsort((tok, who))
        who, tok, df = who[order], tok[order], df[order]
        start = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
        cut = np.append(start, len(who))
        size = dict(zip(known.column("doc_id").to_pylist(), known.column("n").to_pylist(), strict=True))
        out = []
        for k, a in enumerate(start):
            n, held = size.get(int(who[a]), 0), int(cut[k + 1] - a)
            if held >= max(1, rule.need(n)):
                out.append((int(who[a]), n, T.planes(tok[a : cut[k + 1]]), T.planes(df[a : cut[k + 1]])))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "tokens": pa.array(cols[2], pa.binary()), "df": pa.array(cols[3], pa.binary())})

    return shared.groupBy("q").cogroup(sizes.groupBy("q")).applyInArrow(run, "doc_id long, n long, tokens binary, df binary")


def order_key(tok: np.ndarray, k: int) -> np.ndarray:
    """Tie-break of order k among shingles of one frequency."""
    return T.mix(tok + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def prefix(tok: np.ndarray, df: np.ndarray, n: int, k: int, rule: Rule) -> np.ndarray:
    """The shared shingles in the prefix of a set under order k. The n - len(tok) unique shingles stand before all of them."""
    return np.lexsort((order_key(tok, k), df))[: max(0, n - rule.need(n) + 1 - (n - len(tok)))]


def prefixes(found: DataFrame, rule: Rule) -> DataFrame:
    """(token, rep, centre): prefix shingles under the first order, and how central the document is: its shingles' mean log frequency."""

    def run(batches):
        for batch in batches:
            tokens, reps, centres = [], [], []
            for rep, n, t, d in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                tok, df = T.unplanes(t, np.uint64), T.unplanes(d, np.uint32)
                p = tok[prefix(tok, df, n, 0, rule)]
                tokens.append(p.view(np.int64))
                reps.append(np.full(len(p), rep))
                centres.append(np.full(len(p), np.log(df).sum() / n))
            z = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(z + tokens), pa.int64()), "rep": pa.array(np.concatenate(z + reps), pa.int64()), "centre": pa.array(np.concatenate([np.zeros(0), *centres]), pa.float64())})

    return found.select("rep", "n", "tokens", "df").mapInArrow(run, "token long, rep long, centre double")


def incidence(sets: list[np.ndarray], universe: np.ndarray) -> np.ndarray:
    """0/1 matrix of sets by members of the sorted universe."""
    m = np.zeros((len(sets), len(universe)), np.float32)
    for i, x in enumerate(sets):
        k = np.searchsorted(universe, x)
        k[k == len(universe)] = 0
        m[i, k[universe[k] == x]] = 1 if len(universe) else 0
    return m


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a left with a right set, by products of incidence matrices of bounded width."""
    uniq = lambda xs: (lambda s: s[np.append(True, s[1:] != s[:-1])] if len(s) else s)(np.sort(np.concatenate(xs)))
    both = np.intersect1d(uniq(left), uniq(right), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, len(both), width):
        u = both[i : i + width]
        out += incidence(left, u) @ incidence(right, u).T
    return out


def links(left: list[tuple[int, np.ndarray, np.ndarray]], right: list[tuple[int, np.ndarray, np.ndarray]], rule: Rule) -> np.ndarray:
    """Boolean matrix of the pairs (size, tokens, df) that are alike enough.

    Filters come first: the length bound, and under every order a common prefix shingle and the positional bound: beyond
    the prefix that ends first, no more than the rest of its set can be shared. What passes all of them is verified.
    """
    na, nb = (np.array([x[0] for x in s], np.int64) for s in (left, right))
    ok = (na[:, None] * rule.below >= nb[None, :] * rule.above) & (nb[None, :] * rule.below >= na[:, None] * rule.above)
    need = -(-(na[:, None] + nb[None, :]) * rule.above // (rule.above + rule.below))
    for k in range(ORDERS):
        if not ok.any():
            return ok
        pa_, pb = ([t[prefix(t, d, n, k, rule)] for n, t, d in s] for s in (left, right))
        shared = overlaps(pa_, pb)
        rest = np.maximum(*(np.array([rule.need(int(x)) - 1 for x in n])[at] for n, at in ((na, np.s_[:, None]), (nb, np.s_[None, :]))))
        ok &= (shared > 0) & (shared + rest >= need)
    rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    if not len(rows):
        return ok
    inter = overlaps([left[i][1] for i in rows], [right[j][1] for j in cols]).astype(np.int64)
    union = na[rows][:, None] + nb[cols][None, :] - inter
    out = np.zeros_like(ok)
    out[np.ix_(rows, cols)] = rule.below * inter >= rule.above * union
    return out & ok


def forest(a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of a block pair, as (smallest id of the tree, id)."""
    ids = np.unique(np.concatenate([a, b]))
    root = np.arange(len(ids))
    i, j = np.nonzero(hit)
    i, j = np.searchsorted(ids, a[i]), np.searchsorted(ids, b[j])
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(ids)))
    return list(zip(ids[root[at]].tolist(), ids[at].tolist(), strict=True))


def block_edges(found: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): a spanning forest of the links between documents (rep, n, tokens, df)."""
    p = materialise(prefixes(found, rule), "prefixes")
    pivots = p.groupBy("token").agg(F.max(F.struct("centre", "rep")).alias("pivot"), F.count("*").alias("members")).where("members > 1")
    near = p.join(pivots, "token").groupBy("rep").agg(F.max("pivot")["rep"].alias("root"))
    sizes = near.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = near.join(sizes, "root").select("rep", F.xxhash64("root", F.pmod(F.xxhash64("rep"), "parts")).alias("block"))
    dealt = materialise(dealt, "blocks")
    by_token = p.select("token", "rep").join(dealt, "rep").select("token", "block").distinct()
    across = by_token.alias("x").join(by_token.alias("y"), "token").where("x.block < y.block").select(F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    inside = dealt.groupBy("block").count().where("count > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))
    pairs = across.distinct().unionByName(inside).withColumn("pair", F.xxhash64("a", "b"))
    sides = pairs.select("pair", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select("pair", F.col("b").alias("block"), F.lit(1).alias("side")))
    members = found.join(dealt, "rep")
    rows = sides.join(members, "block").select("pair", "side", "rep", "n", "tokens", "df")

    def run(table: pa.Table) -> pa.Table:
        side, rep = table.column("side").to_numpy(), table.column("rep").to_numpy()
        sets = [(n, T.unplanes(t, np.uint64), T.unplanes(d, np.uint32)) for n, t, d in zip(table.column("n").to_pylist(), table.column("tokens").to_pylist(), table.column("df").to_pylist(), strict=True)]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        hit = links([sets[i] for i in left], [sets[i] for i in right], rule)
        edges = forest(rep[left], rep[right], hit)
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([x for _, x in edges], pa.int64())})

    return rows.groupBy("pair").applyInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document.

    component_id is the smallest id reachable by links, the document's own included. Documents without words have an
    empty set, link with nothing and keep their own id; so do rows whose id is null. One id stands for one text: a
    repeated row counts once for links and keeps its row in the result. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    configure(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = materialise(set_keys(docs, rule), "sets")
    full = keys.where("n_shingles > 0 and doc_id is not null")
    reps = materialise(full.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep")), "reps")
    # A word has a shingle of 16 bytes in this exchange.
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    width = buckets(spark, size * 16 / 6, RANGE_BYTES)
    homes = width + 1 - width % 2
    shared = gather_shared(scatter(docs.where("doc_id is not null"), rule, width), homes)
    s = materialise(survivors(shared, keys, rule, homes), "survivors")
    named = s.join(full.join(reps, ["n_shingles", "k1", "k2"]).select("doc_id", "rep").distinct(), "doc_id")
    found = materialise(named.groupBy("rep").agg(F.min_by(F.struct("n", "tokens", "df"), "doc_id").alias("x")).select("rep", "x.*"), "found")
    tree = components(block_edges(found, rule))
    named = reps.join(tree.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    linked = keys.join(named, ["n_shingles", "k1", "k2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_representatives(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component (that of the smallest id); all rows of documents without words or id stay."""
    c = jaccard_components(docs, rule, id_col)
    gone = c.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
