"""The registered queries of this subpackage: thin contracts over the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, html_text, jaccard, lloyd, maxent, mixing, neighbours, oracles, quality, secrets, substrings, toxicity, urls, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_of(parts) -> F.Column:
    return F.sha2(F.array_join(parts, ",").cast("binary"), 256)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels are learnt from rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.quality_model(docs, labels, quality.fold("doc_id", 3) != 1)
    scored = quality.score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", (quality.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's overlap with the benchmark's 13-word windows."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    d = decontaminate.mark_hits(docs, decontaminate.make_indexes(docs, items), ["doc_id"])
    rule = decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256_of("items").alias("items_sha256"), rule.alias("contaminated"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secret spans; the digest is of the three base kinds."""
    d = secrets.scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("secret_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", count("assign"), count("access"), count("hex"), sha256_of(F.transform(base, name)).alias("base_sha256"), F.array_join(F.transform("secret_spans", name), ",").alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; labels are learnt from rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.toxicity_model(docs, labels, quality.fold("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", (quality.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 100-byte strings."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: the given rules', else that of rules mined from labelled pages (poor or toxic ones are bad)."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    mined = urls.mine_rules(pages.select("page_id", "url").join(bad, "page_id").select("url", (F.col("bad") == 1).alias("bad")))
    return urls.filter_urls(pages, urls.RULES, mined)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component at cosine 0.95 or more."""
    return neighbours.embedding_components(table(spark, sf_dir, "embeddings"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of documents with five-word shingle sets of similarity 0.8 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first 16 whitened components."""
    return whitening.embedding_whitening(table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds over 40 centroids."""
    return lloyd.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under counts and under the model; a seventh of the documents is not learnt from."""
    return maxent.language_model_scores(table(spark, sf_dir, "documents"), maxent.held_out_rows())


_ALL = (
    op1_quality_classifier,
    op2_benchmark_decontamination,
    op3_secret_scans,
    op4_toxicity,
    op5_suffix_array_dedup,
    op6_url_filters,
    op7_embedding_near_dedup,
    op8_ngram_jaccard_join,
    op9_mixing,
    op10_html_extraction,
    op11_embedding_whitening,
    op12_centroid_clustering,
    op13_lm_scoring,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": oracles.OP2_SQL,
    "op5_suffix_array_dedup": oracles.OP5_SQL,
    "op7_embedding_near_dedup": oracles.OP7_SQL,
    "op8_ngram_jaccard_join": oracles.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op12_centroid_clustering": oracles.OP12_SQL,
}
