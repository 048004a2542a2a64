"""Operator 1: quality classifier, and what operator 4 shares with it.

Hashed word n-grams, logistic regression fitted by FTRL on a bounded sample of labelled rows, scored as sparse dot
products in one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import text as T
from quillon.llm.common import configure, materialise
from quillon.llm.linear import Features, Model, fit

#: Labelled rows the classifier is fitted on at most, those whose hashed id is lowest, and bytes of their texts. The bounds keep what reaches the driver constant.
TRAIN_ROWS, TRAIN_BYTES = 5000, 24 << 20
QUALITY = Features(bits=18, marks=True, norm=True)


def fold(column: str, k: int):
    """crc32 of the id as text, modulo ``k``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int, id_col: str = "doc_id", most: int = TRAIN_BYTES) -> DataFrame:
    """(id, text, y), written once: labelled rows that pass ``keep``, at most ``rows`` of them and ``most`` bytes of text, chosen by hashed id.

    An id with several labels counts with the largest, one with several rows with the least text, so repeated rows weigh once.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & keep).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(rows).withColumnRenamed(id_col, "id")
    # At most ``rows`` ids: bounded, so one side is broadcast, and their sizes pass one window.
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    picked = materialise(picked.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "sample")
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("id"), "id"))
    return picked.join(F.broadcast(picked.select("id", so_far.alias("so_far")).where(F.col("so_far") <= most).select("id")), "id")


def vectors(sampled: DataFrame, features: Features, swaps: Callable[[str], list[tuple[str, float]]] | None = None) -> list:
    """Feature vectors of a bounded sample, on the driver: (label, places, values, what each counterfactual changes).

    ``swaps(text)`` gives counterfactual texts and their weights; of each only the places in which its vector differs are kept.
    """

    def run(batches):
        for batch in batches:
            out = []
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                others = swaps(t) if swaps else []
                b, o = T.strings(pa.array([t, *[x for x, _ in others]], pa.large_string()))
                doc, place, v = features.of(b, o)
                at = place[doc == 0], v[doc == 0]
                out.append((y, 0.0, at[0].astype(np.int32).tobytes(), at[1].astype(np.float32).tobytes() if features.norm else b""))
                for k, (_, weight) in enumerate(others, 1):
                    every, d = change(at, (place[doc == k], v[doc == k]))
                    out.append((y, weight, every.astype(np.int32).tobytes(), d.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_pydict({"y": pa.array([r[0] for r in out], pa.int32()), "weight": pa.array([r[1] for r in out], pa.float64()), "at": pa.array([r[2] for r in out], pa.binary()), "v": pa.array([r[3] for r in out], pa.binary())})

    rows: list = []
    for r in sampled.select("text", "y").mapInArrow(run, "y int, weight double, at binary, v binary").collect():
        at = np.frombuffer(r.at, np.int32).astype(np.int64)
        if r.weight:
            rows[-1][3].append((at, np.frombuffer(r.v, np.float32).astype(float), r.weight))
        else:
            rows.append((r.y, at, np.frombuffer(r.v, np.float32).astype(float) if features.norm else np.ones(len(at)), []))
    return sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes()))


def change(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a less b, without places where they agree."""
    every, back = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    d = np.bincount(back, np.concatenate([a[1], -b[1]]), len(every))
    return every[d != 0], d[d != 0]


def score(docs: DataFrame, model: Model, keep: list[str], into: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` and the model's score of ``text``.

    Null and empty texts get the bias alone, so equal scores; repeated rows score alike; very long texts are scored whole;
    an empty table gives no rows. Of other columns only ``keep`` is read, so their names can't clash.
    """
    configure(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    names = [f.name for f in at.schema.fields[:-1]]

    def run(batches):
        m = shared.value
        for batch in batches:
            s = m.scores(*T.strings(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], names=[*names, into])

    schema = at.select(*names).schema.add(into, "double")
    return at.mapInArrow(run, schema)


def quality_model(docs: DataFrame, labels: DataFrame, keep=None, rows: int = TRAIN_ROWS) -> Model:
    """Fit ``labels.quality`` on at most ``rows`` labelled texts for which the Column ``keep`` (over labels) holds.

    No such texts, or only one label among them, give a model that scores every text alike.
    """
    configure(docs.sparkSession)
    got = vectors(sample(docs, labels, "quality", F.lit(True) if keep is None else keep, rows), QUALITY)
    return fit(QUALITY, got, alpha=0.5, l1=0.02, l2=0.5, epochs=4)


def score_quality(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """One row per document: ``keep`` and ``score`` (0 to 1, higher is better), as ``score`` says."""
    return score(docs, model, keep)
