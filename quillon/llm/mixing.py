"""Operator 9: mixing sources to target weights, with DataFrame functions only.

Capped water-filling: every source's share of all words follows its weight, but stops at ``max_epochs`` times its own
words; what it cannot take is reshared by weight among the others. The limit of that resharing is
``target = min(cap, level * weight)`` with one common level, which is found from running sums over the sources ordered by
cap / weight. Each document is then repeated a whole number of times, and a seeded part of every source once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Steps of the seeded order in which a source's documents are taken once more.
STEPS = 4096


def word_count(text: str | Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """(source, source_size, target) of rows (source, source_size): sources by code point, null last, take ``weights`` in turn.

    One row per source goes through one window: sources are few, documents never pass here. A source without words has
    target 0; no sources give no rows.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w)
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("here", (F.sum("source_size").over(everything).cast("double") - F.col("cap_before")) / F.col("weight_left"))
    # The level is the first one, in order of cap / weight, that its own source can take in full.
    s = s.withColumn("level", F.min(F.when(F.col("here") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "here"))).over(everything)["here"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def step_of(id_col: str, seed: int) -> Column:
    """A seeded step, 0 to STEPS - 1, for an id; equal ids share it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 3), 16, 10).cast("int")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, seed: int = 17, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``keep`` columns, id, size, source_size, target, taken (words the mix takes, repeats counted).

    With ``ratio = target / source_size``, each document is taken ``floor(ratio)`` times whole. For the rest, a source's
    documents go through in order of a seeded step; steps that fit are taken once more, and the step at the edge gives
    the same fraction of each of its documents. A source's total so differs from its target by less than a word for each
    document at the edge, and no document passes ``max_epochs`` times its size.

    Sizes are summed by (source, step) before anything is ordered, so a source with a third of all rows is nowhere in one
    task. Null text has size 0, null sources form one source, repeated rows are mixed as they stand, an empty table
    gives no rows; other columns are ignored.
    """
    kept = F.struct(*keep) if keep else F.lit(None)
    d = docs.select(kept.alias("_kept"), F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    d = d.withColumn("step", step_of("doc_id", seed))
    steps = d.drop("_kept").groupBy("source", "step").agg(F.sum("size").alias("step_size"))
    by_source = steps.groupBy("source").agg(F.sum("step_size").alias("source_size"))
    t = targets(by_source, weights, max_epochs)
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    p = steps.alias("a").join(F.broadcast(t.alias("b")), same).select("a.source", "step", "step_size", "source_size", "target", "whole", "rest")
    run = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("before", F.coalesce(F.sum("step_size").over(run), F.lit(0)))
    part = F.when(F.col("step_size") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("rest") - F.col("before")) / F.col("step_size")))).otherwise(0.0)
    p = p.withColumn("part", part).select("source", "step", "source_size", "target", "whole", "part")
    plan = p.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("whole").alias("whole"), F.map_from_entries(F.collect_list(F.struct("step", "part"))).alias("parts"))
    # One row per source and at most STEPS entries in it: bounded by the number of sources, which is checked before broadcasting.
    plan = F.broadcast(plan) if plan_fits(docs) else plan
    j = d.alias("a").join(plan.alias("b"), same)
    extra = F.floor(F.col("a.size") * F.element_at("b.parts", F.col("a.step")) + 0.5)
    return j.select(*[F.col(f"a._kept.{c}") for c in keep], "a.doc_id", "a.size", "b.source_size", "b.target", (F.col("a.size") * F.col("b.whole") + extra).cast("long").alias("taken"))


#: Sources up to which their plan (about 50 kB each) is broadcast; beyond, Spark joins it by source.
BROADCAST_SOURCES = 400


def plan_fits(docs: DataFrame) -> bool:
    return docs.select(F.col("source").cast("string").alias("source")).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INTEGER) AS step
  FROM documents),
steps AS (SELECT source, step, CAST(sum(size) AS BIGINT) AS step_size FROM d GROUP BY source, step),
src AS (SELECT source, CAST(sum(step_size) AS BIGINT) AS source_size FROM steps GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rnk, 3.0::DOUBLE * source_size AS cap FROM src),
v AS (SELECT *, (1 + (rnk - 1) % 3)::DOUBLE AS weight FROM w),
x AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM v WINDOW o AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, (total - cap_before) / weight_left AS here FROM x),
lev AS (SELECT first(here ORDER BY cap / weight, rnk) AS level FROM y WHERE here * weight <= cap),
t AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM y LEFT JOIN lev ON true),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (
  SELECT s.source, s.step, s.step_size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS rest,
         coalesce(sum(s.step_size) OVER (PARTITION BY s.source ORDER BY s.step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM steps s JOIN u ON s.source IS NOT DISTINCT FROM u.source)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(d.size * r.whole + floor(d.size * CASE WHEN r.step_size > 0 THEN greatest(0.0, least(1.0, (r.rest - CAST(r.before AS DOUBLE)) / r.step_size)) ELSE 0 END + 0.5) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.step = r.step
"""
