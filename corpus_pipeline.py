"""A corpus pipeline of five stages, each one of the operators of quillon.llm applied to all its predecessor kept.

Every stage takes documents with null, empty and very long texts, null ids and sources, repeated rows, no rows at all, and
columns of any names, and handles them as its operator says: texts without words are scored by the model's bias alone, are
alike nothing, hold no passage and no secret, and have size 0 in the mix; repeated rows are treated alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, jaccard, mixing, quality, secrets
from quillon.llm.common import shared_dir


def _rows(docs: DataFrame) -> DataFrame:
    """Documents as one struct next to what an operator reads, so that no column of theirs can clash with its results."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents the quality classifier rejects (score under 0.5) go. It is fitted on labelled documents, at most TRAIN_ROWS rows and TRAIN_BYTES of them."""
    model = quality.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(_rows(docs), model, ["_row"]).where("score >= 0.5").select("_row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of each group of near copies the document of the smallest id stays."""
    return jaccard.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: documents that benchmark passages make up a twentieth of or more go."""
    indexes = decontaminate.make_indexes(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    marked = decontaminate.mark_hits(_rows(docs), indexes, ["_row"])
    return marked.where(~decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))).select("_row.*")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: secrets in texts are replaced by a mark; every document stays."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: how many words of each document the mix takes, with the document: its text, free of secrets, its language and source."""
    return mixing.mix_sources(docs, keep=[c for c in ("text", "lang", "source") if c in docs.columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", hide_secrets),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/quillon/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The classifier and the structural secret scan have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None
