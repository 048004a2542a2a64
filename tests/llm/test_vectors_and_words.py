"""Embedding whitening, dual-tree clustering and language-model scoring, against plain versions and on odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import lloyd, maxent, whitening
from quillon.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vectors_of(spark, sf=SF):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)


def odd_vectors(spark, width, huge=1e6):
    """Nulls in every column, non-finite and null entries, zeros, copies under one id and under others, another length, a clashing column."""
    r = np.random.default_rng(1)
    x = r.normal(size=(8, width)).astype("float32").tolist()
    rows = [(i, v, 1) for i, v in enumerate(x)]
    rows += [(0, x[0], 1), (90, x[0], None), (None, x[1], 2), (91, None, 1), (92, [float("nan"), *x[2][1:]], 1), (93, [None, *x[2][1:]], 1)]
    rows += [(94, [float("inf"), *x[2][1:]], 1), (95, [0.0] * width, 1), (96, x[3][:3], 1), (97, [huge, *x[4][1:]], 1), (98, [], 1)]
    odd = spark.createDataFrame(rows, VECTORS)
    for c in ("x", "d", "n", "cluster", "component", "slot", "ids"):
        odd = odd.withColumn(c, F.lit("clash"))
    return odd


def test_merged_summaries_are_those_of_all_rows():
    r = np.random.default_rng(0)
    x = r.integers(-60, 60, (700, 12)) + 1_000_000
    x[:, 3] = x[:, 2]  # a direction without variance stays one
    parts = [whitening.summarise(x[i : i + k]) for i, k in ((0, 1), (1, 5), (6, 400), (406, 294))]
    got = whitening.merge([whitening.merge(parts[:2]), whitening.merge(parts[2:])])
    centred = x - x.mean(0)
    assert got.n == 700 and got.sums.tolist() == x.sum(0).tolist() and got.factor.shape == (12, 12)
    assert np.allclose(got.factor.T @ got.factor, centred.T @ centred, rtol=1e-10, atol=1e-6)
    assert len(whitening.whitening(got, 16).variances) == 11
    again = whitening.unpacked({k: v[0].as_py() for k, v in whitening.packed([0], [got]).items()})
    assert again.n == got.n and (again.factor == got.factor).all() and again.sums.tolist() == got.sums.tolist()


def test_deviations_are_exact_or_null():
    w = whitening.Whitening(10, np.array([5, 7], object), np.eye(2), np.ones(2), 2.0)
    assert w.deviations(w.apart(np.array([[1, 2], [3, 4]]))) == [25 + 169, 625 + 1089]
    big = w.apart(np.array([[1 << 40, 0]]))
    assert w.deviations(big) == [None]
    assert w.deviations(w.apart(np.array([[1 << 27, 0]]))) == [(10 * (1 << 27) - 5) ** 2 + 49]


@pytest.mark.parametrize("fan", [2, 16])
def test_whitening_against_numpy(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN_IN", fan)
    ids, e = vectors_of(spark)
    docs = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(9)
    got = whitening.embedding_whitening(docs).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * e).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    ev, vec = np.linalg.eigh(c.T @ c / n)
    ev, vec = ev[::-1], vec[:, ::-1][:, :16]
    want = (x - s / n) @ vec / np.sqrt(ev[:16])
    have = got.whitened.to_numpy().reshape(-1, 16)[np.argsort(np.argsort(ids))]
    assert np.abs(have * np.sign((have * want).sum(0)) - want).max() < 1e-9
    assert got.deviation.to_numpy().reshape(-1, 16)[:, 0].tolist() == ((n * x - s) ** 2).sum(1)[np.argsort(ids)].tolist()
    assert np.allclose(got.explained.to_numpy()[:16], ev[:16] / ev.sum(), rtol=1e-9) and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and 0 < got.identity_error.iloc[0] < 1e-9
    assert set(got.component) == set(range(1, 17)) and len(got) == 16 * len(ids)


def test_whitening_of_odd_rows(spark):
    got = whitening.embedding_whitening(odd_vectors(spark, 6)).collect()
    by = collections.Counter(r.vec_id for r in got)
    # Six dimensions, ten distinct vectors of them; the vector of three dimensions is alone in its space.
    assert by == {**{i: 6 for i in range(1, 8)}, 0: 12, 90: 6, None: 6, 95: 6, 97: 6} and {r.n for r in got} == {10}
    # Beside an entry as large as that, nothing else varies within double precision.
    assert {(r.component, r.deviation) for r in whitening.embedding_whitening(odd_vectors(spark, 6, 1e30)).collect()} == {(1, None)}
    same = {r.component: r.whitened for r in got if r.vec_id == 90}
    assert all(same[r.component] == r.whitened for r in got if r.vec_id == 0)
    for empty in (spark.createDataFrame([], VECTORS), spark.createDataFrame([(1, None, 1)], VECTORS), spark.createDataFrame([(1, [1.0], 1)] * 3, VECTORS)):
        found = whitening.embedding_whitening(empty)
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def plain_lloyd(ids, x, k, rounds):
    """Lloyd's rounds in whole numbers, all pairs."""
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in zip(ids, x.tolist(), strict=True) if i is not None)
    c = np.array([v for _, v in hashed[:k]], np.int64)
    for n in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        who = d.argmin(1)
        if n < rounds:
            c = np.array([[s // m for s in x[who == j].sum(0).tolist()] if (m := int((who == j).sum())) else c[j].tolist() for j in range(len(c))])
    return who, d.min(1), c


def test_dual_walk_against_all_pairs():
    r = np.random.default_rng(2)
    for trial in range(30):
        width, n, k = int(r.integers(1, 9)), int(r.integers(1, 400)), int(r.integers(1, 40))
        spots = r.integers(-300, 300, (int(r.integers(1, 12)), width))
        x = spots[r.integers(0, len(spots), n)] + r.integers(-3 - trial % 4 * 20, 4 + trial % 4 * 20, (n, width))
        x[: n // 3] = x[0]
        c = np.concatenate([x[r.integers(0, n, k)], x[:1]])  # equal centroids, ties
        tree, order = lloyd.cover_tree(x, leaf=int(r.integers(1, 20)))
        assert sorted(order.tolist()) == list(range(n)) and (tree.points == x[order]).all()
        for v in range(len(tree.centre)):
            far = np.sqrt(((tree.points[tree.first[v] : tree.last[v]] - tree.points[tree.centre[v]]) ** 2).sum(1))
            assert np.isclose(far.max(), tree.radius[v]) and tree.first[v] <= tree.centre[v] < tree.last[v]
            kids = tree.centre[tree.low[v] : tree.high[v]]
            apart = np.sqrt(((tree.points[kids][:, None] - tree.points[kids][None]) ** 2).sum(2))
            assert not len(kids) or (apart[~np.eye(len(kids), dtype=bool)] > tree.radius[v] / 2).all()
        own, number = lloyd.cover_tree(c, leaf=4)
        who, best, compared = lloyd.nearest(tree, own, number)
        d = ((tree.points[:, None] - c[None]) ** 2).sum(2)
        assert (who == d.argmin(1)).all() and (best == d.min(1)).all() and compared <= n * len(c)


def test_bounds_leave_most_pairs_out():
    r = np.random.default_rng(5)
    spots = r.integers(-1000, 1000, (30, 16))
    x = spots[r.integers(0, 30, 900)] + r.integers(-5, 6, (900, 16))
    tree, _ = lloyd.cover_tree(x)
    own, number = lloyd.cover_tree(spots, leaf=4)
    _, _, compared = lloyd.nearest(tree, own, number)
    assert compared < 0.2 * len(x) * len(spots)


def test_clustering_against_plain_rounds(spark):
    ids, e = vectors_of(spark)
    x = np.floor(256 * e).astype(np.int64)
    who, d, c = plain_lloyd(ids, x, 40, 5)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    for df in (table, table.repartition(7)):
        got = {r.vec_id: r for r in lloyd.cluster_vectors(df).collect()}
        assert len(got) == len(ids)
        for i, j, far in zip(ids, who.tolist(), d.tolist(), strict=True):
            r = got[i]
            digest = hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()
            assert (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) == (j, far, d[who == j].sum(), d.sum(), digest)


def test_clustering_of_odd_rows(spark):
    got = lloyd.cluster_vectors(odd_vectors(spark, 64, 1e30), k=5).collect()
    assert collections.Counter(r.vec_id for r in got) == {**{i: 1 for i in range(1, 8)}, 0: 2, 90: 1, None: 1, 95: 1, 97: 1}
    assert {r.inertia for r in got} == {sum(r.distance for r in got)} and {r.cluster for r in got} <= set(range(5))
    for empty in (spark.createDataFrame([], VECTORS), spark.createDataFrame([(1, [1.0], 1)], VECTORS), spark.createDataFrame([(None, [1.0] * 64, 1)], VECTORS)):
        assert lloyd.cluster_vectors(empty).collect() == []


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def plain_base(rows):
    """{id: (held out, tokens, known, N, base score)} of (id, text)."""
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    c = collections.Counter(x for i, t in rows if not held[i] for x in [*words(t), None])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        tokens = [*words(t), None]
        out[i] = held[i], len(tokens), sum(c[x] > 0 for x in tokens), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens)
    return out


@pytest.mark.parametrize("head", [0, 100, 1 << 20])
def test_base_scores_against_counts(spark, head):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    want = plain_base([(r.doc_id, r.text) for r in docs.collect()])
    for r in maxent.language_model_scores(docs, maxent.held_out_rows(), head_words=head).collect():
        out, tokens, known, n, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_model_is_better_than_counts_on_held_out_texts(spark):
    got = QUERIES["op13_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (got.s - got.b) / got.n > 0.1


def test_order_of_words_matters(spark):
    r = np.random.default_rng(3)
    vocabulary = ["alpha", "beta", "gamma", "delta"]
    chain = lambda k: [vocabulary[(i + k) % 4] for i in range(40)]
    rows = [(i, " ".join(chain(i))) for i in range(400)] + [(1000, " ".join(chain(0))), (1001, " ".join(r.permutation(chain(0))))]
    got = {x.doc_id: x for x in maxent.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    assert got[1000].base_score == pytest.approx(got[1001].base_score) and got[1000].score > got[1001].score + 5 and got[1000].score > got[1000].base_score / 2


def test_probabilities_add_up_to_one(spark):
    """Over all words of training, the end and one unknown word for each class, whatever stands before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).select("text")
    counts = maxent.count_words(docs).cache()
    voc = maxent.vocabulary(counts, 30)
    ones = 1 + len(voc.single)  # classes of one word, the end's first, have no unknown word
    assert voc.mass.sum() == pytest.approx(voc.tokens + voc.distinct + len(voc.mass) - ones)
    own = collections.Counter()
    for w in counts.collect():
        own[int(voc.classes(np.array([w.word]).view(np.uint64), np.array([w.ending]))[0])] += w.n + 1
    assert all(own[k] + (k >= ones) == voc.mass[k] for k in range(1, len(voc.mass))) and sum(own.values()) + voc.texts + 1 == voc.tokens + voc.distinct
    z = maxent.start(voc).logits(np.zeros((4, 1), np.uint32))[0]
    assert np.exp(z).sum() == pytest.approx(1, rel=1e-5)


def test_scores_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, head string, part string, id string"
    long = "word " * 60_000
    rows = [(1, "Ab ab", "x", "c", "c", "c"), (1, "Ab ab", "x", "c", "c", "c"), (None, None, None, None, None, None), (2, "", "x", "c", "c", "c"), (3, " \n", None, "c", "c", "c"), (4, long, "x", "c", "c", "c"), (5, "néw Ab", "x", "c", "c", "c")]
    df = spark.createDataFrame(rows, schema)
    got = maxent.language_model_scores(df, F.col("doc_id") == 5).collect()
    assert sorted((r.n_tokens, r.n_known) for r in got) == [(1, 1), (1, 1), (1, 1), (3, 2), (3, 3), (3, 3), (60_001, 60_001)] and {r.train_tokens for r in got} == {60_010}
    assert len({(r.base_score, r.score) for r in got if r.n_tokens == 1}) == 1 and all(r.score <= 0 for r in got)
    assert maxent.language_model_scores(df.limit(0), F.col("doc_id") == 5).count() == 0
    alone = maxent.language_model_scores(df, F.lit(True)).collect()
    assert len(alone) == 7 and {(r.n_known, r.train_tokens, r.base_score) for r in alone} == {(0, 0, 0.0)} and all(r.score <= 0 for r in alone)
