"""Registered queries of the table operators: each calls the library's function, and stands next to SQL written on its own for the second engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import time_series as ts
from quillon.operators import alignment as al
from quillon.operators import folds, orderbook, regression, results, selection
from quillon.operators.json_tree import json_nodes
from quillon.plans import builder
from quillon.plans.blocks import BlockedPanel
from quillon.plans.layers import DATE, NAME, Layers, SqlText
from quillon.plans.panel import at_close, validate_panel, validate_wide, weekly_panel, weekly_text
from quillon.plans.storage import shared_folder, written
from quillon.sources import tables
from quillon.sources.batches import read_batches, write_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, panel: bool = False):
    """Register a query; with ``panel`` the oracle is a SELECT over the weekly panel. Without an oracle, one registered elsewhere under the name stays."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = weekly_text().query(oracle, []) if panel else oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel as a table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return weekly_panel(spark, sf_dir).frame([])


def six(c: str, name: str | None = None):
    return (F.round(F.col(c).cast("double") + 1.3e-10, 6) + F.lit(0.0)).alias(name or c)


# Alignment.
@query("jn1_inner_align")
def _(spark, d):
    p = cells(spark, d)
    return al.inner_align(p.where("industry <> 'r1'").select(DATE, NAME, "price"), p.where("tradeable").select(DATE, NAME, "volume"))


@query("jn2_right_align")
def _(spark, d):
    p = cells(spark, d)
    return al.align_to(p.where("label IS NOT NULL").select(DATE, NAME, "label"), p.where("tradeable").select(DATE, NAME, "price"))


@query("jn3_reindex", f"SELECT t.{DATE}, t.{NAME}, p.price FROM (SELECT {DATE}, {NAME} FROM {{panel}} WHERE industry = 'r2') t LEFT JOIN (SELECT {DATE}, {NAME}, price FROM {{panel}} WHERE volume > 20) p ON t.{DATE} = p.{DATE} AND t.{NAME} = p.{NAME}", panel=True)
def _(spark, d):
    p = cells(spark, d)
    return al.align_to(p.where("industry = 'r2'").select(DATE, NAME), p.where("volume > 20").select(DATE, NAME, "price"))


@query("jn4_common_index", f"SELECT {DATE}, {NAME}, price, tax, discount FROM {{panel}} WHERE tradeable AND price > 1200 AND tax > 0.02 AND discount > 0.03", panel=True)
def _(spark, d):
    p = cells(spark, d)
    return al.inner_align(p.where("tradeable AND price > 1200").select(DATE, NAME, "price"), p.where("tax > 0.02").select(DATE, NAME, "tax"), p.where("discount > 0.03").select(DATE, NAME, "discount"))


@query("jn5_outer_concat")
def _(spark, d):
    p = cells(spark, d)
    return al.outer_concat(p.where("industry <> 'r1'").select(DATE, NAME, "price"), p.where("tradeable").select(DATE, NAME, "volume"))


@query("jn6_tradeable_fill")
def _(spark, d):
    p = cells(spark, d)
    flags = p.where("tradeable AND lines > 1").select(DATE, NAME, F.lit(1).alias("flag"))
    return al.fill_from(p.select(DATE, NAME), flags, "flag")


@query("jn7_concat_first", f"SELECT coalesce(a.{DATE}, b.{DATE}) AS {DATE}, coalesce(a.{NAME}, b.{NAME}) AS {NAME}, a.price, a.volume, b.tax FROM (SELECT * FROM {{panel}} WHERE industry <> 'r0') a FULL OUTER JOIN (SELECT * FROM {{panel}} WHERE tradeable) b ON a.{DATE} = b.{DATE} AND a.{NAME} = b.{NAME}", panel=True)
def _(spark, d):
    p = cells(spark, d)
    return al.concat_first(p.where("industry <> 'r0'").select(DATE, NAME, "price", "volume"), p.where("tradeable").select(DATE, NAME, F.lit(0.0).alias("price"), "tax"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    at = F.date_trunc("week", F.date_trunc("quarter", "o_orderdate"))
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias(NAME), at.alias(DATE)).agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("orders"))


@query("jn8_asof_forward_fill")
def _(spark, d):
    """Quarterly reports carried forward to weeks, at most 26 of them."""
    reports = _reports(spark, d)
    weeks = table(spark, d, "lineitem").select(F.date_trunc("week", "l_shipdate").alias(DATE)).distinct()
    targets = weeks.crossJoin(reports.select(NAME).distinct())  # nations, a few dozen
    return al.as_of(reports, targets, ["total", "orders"], 26).select(F.col(NAME).alias("nation"), DATE, F.round("total", 2).alias("total"), "orders")


_SUPPLIER_QUARTERS = f"SELECT date_trunc('quarter', l_shipdate) AS q, l_suppkey AS {NAME}, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2"


@query(
    "jn9_quarterly_to_weekly",
    f"""WITH reports AS ({_SUPPLIER_QUARTERS}), days AS (SELECT DISTINCT {DATE} AS day0, dense_rank() OVER (ORDER BY {DATE}) AS i FROM {{panel}}),
      known AS (SELECT r.{NAME}, r.qty, r.q, (SELECT count(*) FROM days WHERE day0 <= r.q) + 3 AS i FROM reports r),
      dated AS (SELECT k.{NAME}, k.qty, k.q, d.day0 FROM known k JOIN days d ON k.i = d.i),
      last AS (SELECT {NAME}, day0, max_by(qty, q) AS qty FROM dated GROUP BY {NAME}, day0)
      SELECT p.{DATE}, p.{NAME}, l.qty FROM (SELECT DISTINCT {DATE}, {NAME} FROM {{panel}}) p ASOF LEFT JOIN last l ON p.{NAME} = l.{NAME} AND p.{DATE} >= l.day0""",
    panel=True,
)
def _(spark, d):
    """Quarterly quantities, known three dates of the panel later, carried forward."""
    li = table(spark, d, "lineitem")
    reports = li.groupBy(F.date_trunc("quarter", "l_shipdate").alias(DATE), F.col("l_suppkey").alias(NAME)).agg(F.sum("l_quantity").alias("qty"))
    return al.report_to_daily(reports, written(cells(spark, d).select(DATE, NAME), "weeks"), ["qty"], 3)


@query("jn10_11_attributes", "SELECT s.s_suppkey, s.s_acctbal, n.n_name, n.n_regionkey FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey < 3")
def _(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "s_nationkey")
    return al.with_attributes(table(spark, d, "supplier"), n, "s_nationkey").select("s_suppkey", "s_acctbal", "n_name", "n_regionkey")


@query("jn12_lookup")
def _(spark, d):
    return al.lookup(table(spark, d, "supplier"), table(spark, d, "nation"), "s_nationkey", "n_nationkey", {"nation": "n_name"}).select("s_suppkey", "nation")


@query("jn13_cooccurrence")
def _(spark, d):
    return al.cooccurrence(table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("token")), "p_partkey", "token")


# Filters.
@query("pf9_date_subset")
def _(spark, d):
    p = weekly_panel(spark, d)
    m = ts.ts_mean(p, "price", 5)
    df = p.frame([m])
    dates = df.select(DATE).where(f"{DATE} >= TIMESTAMP '1998-01-01' AND {DATE} < TIMESTAMP '1999-01-01'")
    return al.take_dates(df, dates).select(DATE, NAME, six(m, "mean5"))


@query("pf12_session_filter")
def _(spark, d):
    return al.sessions(table(spark, d, "events"), at="ts").select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("pf13_universe_filter")
def _(spark, d):
    return al.universe(cells(spark, d), groups=["r0", "r3"]).where("tradeable").select(DATE, NAME, six("price"))


@query("pf14_column_selection")
def _(spark, d):
    profile = results.column_profile(cells(spark, d), ["price", "volume", "amount", "label", "lines"])
    names = results.select_columns(profile)
    rows = profile.where(F.col("name").isin(names)).select("name", F.round("coverage", 6).alias("coverage"), "uniques")
    place = spark.createDataFrame(list(zip(names, range(1, len(names) + 1), strict=True)), "name string, place int")
    return rows.join(place, "name")


@query("pf15_narrow", f"SELECT {DATE}, {NAME}, CAST(CAST(price AS FLOAT) AS DOUBLE) AS price FROM {{panel}}", panel=True)
def _(spark, d):
    return al.narrow(cells(spark, d).select(DATE, NAME, "price")).withColumn("price", F.col("price").cast("double"))


_RESULTS = "SELECT o_custkey AS gene, o_orderkey AS id, o_totalprice / 400000 - 0.5 AS ric, o_totalprice / 300000 AS rir, o_orderstatus = 'F' AS passed FROM orders"


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("gene"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 400000 - 0.5).alias("ric"), (F.col("o_totalprice") / 300000).alias("rir"), (F.col("o_orderstatus") == "F").alias("passed"))


@query("pf10_metric_filter", f"SELECT DISTINCT gene FROM ({_RESULTS}) r WHERE abs(ric) > 0.2 AND abs(rir) > 0.3 AND passed")
def _(spark, d):
    return results.metric_filter(_results(spark, d), {"ric": 0.2, "rir": 0.3, "absent": 1.0}, "passed", ["gene"]).select("gene")


@query("pf11_high_ic", f"SELECT id, round(ric + 1.3E-10, 6) AS ric, round(rir + 1.3E-10, 6) AS rir FROM ({_RESULTS}) r WHERE ric > 0.05 AND rir > 0.3")
def _(spark, d):
    return results.high_ic(_results(spark, d), "ric", "rir").select("id", F.round(F.col("ric") + 1.3e-10, 6).alias("ric"), F.round(F.col("rir") + 1.3e-10, 6).alias("rir"))


# Results of searches.
@query("ag2_column_profile")
def _(spark, d):
    p = results.column_profile(cells(spark, d), ["price", "volume", "discount", "label"])
    return p.select("name", F.round("coverage", 6).alias("coverage"), F.round("positive", 6).alias("positive"), F.round("zero", 6).alias("zero"), "uniques")


@query("ag3_field_frequency")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.split("p_name", " ")).alias("token"))
    f = results.frequency(rows, ["token"], "p_partkey", {"large": F.col("p_size") > 25})
    return f.select("token", "n", F.col("distinct_n").alias("parts"), F.col("large").cast("double").alias("large"), F.round("share", 6).alias("share"))


@query("ag4_grouped_frequency")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.explode(F.split("p_name", " ")).alias("token"))
    return results.frequency_levels(rows, {"token": ["token"], "brand": ["brand"], "both": ["brand", "token"]}).select(F.col("level").alias("level0"), "k", "n")


_GENES = "SELECT p_partkey AS id, p_brand AS mode, '[{\"slot\": \"anchor\", \"field\": \"' || split_part(p_name, ' ', 1) || '\", \"transform\": \"rank_pct\", \"direction\": 1}, {\"slot\": \"price\", \"field\": \"zscore(' || split_part(p_name, ' ', 2) || ')\", \"transform\": \"tree\", \"direction\": -1}]' AS gene_slots, CASE WHEN p_size > 25 THEN '[{\"field\": \"' || split_part(p_name, ' ', 2) || '\", \"kind\": \"above_median\", \"threshold\": 0.5, \"transform\": \"current\"}]' ELSE 'no json' END AS gene_conditions FROM part"


def _genes(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(_GENES)


@query(
    "ag5_gene_occurrences",
    "SELECT id AS gene_id, mode, 'slot' AS place, 'anchor' AS slot, first AS field, 'rank_pct' AS transform FROM g UNION ALL SELECT id, mode, 'slot', 'price', 'zscore(' || second || ')', 'tree' FROM g UNION ALL SELECT id, mode, 'condition', 'above_median', second, 'current' FROM g WHERE p_size > 25".replace(" FROM g", " FROM (SELECT p_partkey AS id, p_brand AS mode, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second, p_size FROM part) g"),
)
def _(spark, d):
    return results.gene_occurrences(_genes(spark, d), "id", keep=["mode"])


@query("ag7_tree_slots", "SELECT p_brand AS mode, 'price' AS slot, count(*) AS trees, count(*) AS operators FROM part GROUP BY p_brand")
def _(spark, d):
    return results.slot_usage(_genes(spark, d), "mode")


_PROGRAM = "'{\"root\": {\"node\": \"binary\", \"op\": \"add\", \"left\": {\"node\": \"field\", \"field\": \"' || split_part(p_name, ' ', 1) || '\"}, \"right\": {\"node\": \"unary\", \"op\": \"neg\", \"child\": {\"node\": \"field\", \"field\": \"' || split_part(p_name, ' ', 1) || '\"}}}}'"
_EXPRESSION = "'add(' || split_part(p_name, ' ', 1) || ', ts_mean_5(' || split_part(p_name, ' ', 2) || '))'"


@query("ag6_program_usage", "SELECT p_partkey AS gene_id, 'operator' AS kind, 'add' AS name, 1 AS n FROM part UNION ALL SELECT p_partkey, 'operator', 'neg', 1 FROM part UNION ALL SELECT p_partkey, 'field', split_part(p_name, ' ', 1), 2 FROM part")
def _(spark, d):
    return results.program_usage(table(spark, d, "part").select("p_partkey", F.expr(_PROGRAM).alias("program_json")), "p_partkey")


#: Names with quotes in them, keys within text, and numbers, beside nodes of some depth.
_NESTED = """'{"op": "say \\\\"' || p_size || '\\\\"", "note": "\\\\"op\\\\": \\\\"no\\\\"", "args": [{"field": "' || split_part(p_name, ' ', 1) || '"}, [1.50, true, null, {"op": "neg", "args": [{"field": "x.y"}]}]], "deep": {"deep": {"op": ""}}}'"""


@query(
    "ag6_program_nodes",
    f"""WITH RECURSIVE t AS (SELECT p_partkey AS k, json_tree.* FROM (SELECT p_partkey, {_NESTED.replace(chr(92) * 2, chr(92))} AS j FROM part) p, json_tree(p.j)),
      deep AS (SELECT k, id, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.k, t.id, d.depth + 1 FROM deep d JOIN t ON t.k = d.k AND t.parent = d.id),
      n AS (SELECT t.k, t.id, t.parent, d.depth, CASE WHEN u.type = 'OBJECT' THEN t.key END AS name, CASE WHEN u.type = 'ARRAY' THEN CAST(t.key AS INTEGER) END AS place, t.type, t.atom
        FROM t JOIN deep d ON t.k = d.k AND t.id = d.id LEFT JOIN t u ON t.k = u.k AND t.parent = u.id)
      SELECT n.k AS gene_id, n.depth, n.name, n.place, p.name AS parent_name, CASE n.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
        CASE WHEN n.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(CAST(n.atom AS DOUBLE) AS VARCHAR) WHEN n.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN n.atom ->> '$' END AS value
      FROM n LEFT JOIN n p ON n.k = p.k AND n.parent = p.id""",
)
def _(spark, d):
    """Every node of a nested program, with its depth and the name its parent has."""
    n = json_nodes(table(spark, d, "part").withColumn("j", F.expr(_NESTED)), "j", ["p_partkey"], parents=True)
    value = F.when(F.col("kind") == "number", F.col("value").cast("double").cast("string")).otherwise(F.col("value"))
    return n.select(F.col("p_partkey").alias("gene_id"), "depth", "name", "place", "parent_name", "kind", value.alias("value"))


@query(
    "ag6_expression_usage",
    "SELECT kind, name, count(*) AS n, count(DISTINCT e) AS expressions FROM (SELECT 'operator' AS kind, 'add' AS name, p_name AS e FROM p UNION ALL SELECT 'operator', 'ts_mean_5', p_name FROM p UNION ALL SELECT 'field', split_part(p_name, ' ', 1), p_name FROM p UNION ALL SELECT 'field', split_part(p_name, ' ', 2), p_name FROM p) q GROUP BY kind, name".replace(" FROM p", " FROM (SELECT split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS p_name FROM part) p"),
)
def _(spark, d):
    return results.expression_usage(table(spark, d, "part").select(F.expr(_EXPRESSION).alias("expression")))


@query("ag8_combo_statistics")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice").distinct()
    combos = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), " + ").alias("combo"), F.avg("o_totalprice").alias("v"))
    c = results.combo_statistics(combos, "combo", "v", "o_custkey", least=2)
    return c.select("combo", "n", F.round(F.col("mean") + 1.3e-5, 2).alias("mean"), F.round(F.col("median") + 1.3e-5, 2).alias("median"))


@query("ag8_member_sets", "SELECT combo, count(*) AS n, round(avg(v) + 1.3E-5, 2) AS mean, round(quantile_cont(v, 0.5) + 1.3E-5, 2) AS median FROM (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ' + ') AS combo, avg(o_totalprice) AS v FROM orders GROUP BY o_custkey) q GROUP BY combo")
def _(spark, d):
    c = results.combo_statistics(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_custkey")
    return c.select("combo", "n", F.round(F.col("mean") + 1.3e-5, 2).alias("mean"), F.round(F.col("median") + 1.3e-5, 2).alias("median"))


@query("ag9_selection_summary")
def _(spark, d):
    return results.selection_summary(table(spark, d, "customer"), "c_mktsegment", "c_acctbal").select("c_mktsegment", "n", F.col("positive").cast("double").alias("positive"), F.round("mean", 4).alias("mean"))


@query("ag10_five_numbers")
def _(spark, d):
    return results.five_numbers(table(spark, d, "events"), "event_type", "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("q0", "q25", "q50", "q75", "q100")])


@query("ag11_yearly_mean")
def _(spark, d):
    return results.yearly_mean(cells(spark, d).where("tradeable"), "label", ["industry"]).select("year", "industry", (F.round("label", 6) + F.lit(0.0)).alias("label"))


@query("ag12_unpivot")
def _(spark, d):
    return results.melt(table(spark, d, "supplier"), ["s_suppkey"], {"balance": "s_acctbal", "nation": "s_nationkey"})


@query("ag13_category_matrix")
def _(spark, d):
    kinds = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return results.category_matrix(table(spark, d, "orders"), "o_custkey", "o_orderpriority", {f"k{i}": k for i, k in enumerate(kinds)})


@query("ag14_panel_summary")
def _(spark, d):
    return results.panel_summary(cells(spark, d))


@query("so1_2_top_results")
def _(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
    return al.top(results.order_results(o, ["total"], "o_custkey"), 20, [F.desc("total"), "o_custkey"])


@query("so3_top_k_per_group")
def _(spark, d):
    return al.top_per_group(table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], 3, [F.desc("c_acctbal"), "c_custkey"])


@query("so4_prefilter", f"SELECT id, round(rir + 1.3E-10, 6) AS rir FROM ({_RESULTS}) r WHERE rir >= 0.4 ORDER BY r.rir DESC, id LIMIT 50")
def _(spark, d):
    return results.prefilter(_results(spark, d), "rir", 50, "id", 0.4).select("id", F.round(F.col("rir") + 1.3e-10, 6).alias("rir"))


@query("so5_sorted_panel", f"SELECT {DATE}, {NAME}, round(price, 6) AS price FROM {{panel}}", panel=True)
def _(spark, d):
    return al.sort_panel(cells(spark, d).select(DATE, NAME, F.round("price", 6).alias("price")))


@query("st1_union_keep_first")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    a, b = o.where("o_orderstatus = 'F'").select("k", "v", F.lit(0).alias("source")), o.where("o_orderstatus <> 'F'").select("k", "v", F.lit(1).alias("source"))
    return al.union_first(a, b, keys=["k"], order=["v"]).select("k", "source", "v")


@query("st2_keep_last")
def _(spark, d):
    return al.keep_last(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("st3_intersection")
def _(spark, d):
    return al.common(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select("s_nationkey"))


@query("st4_difference", "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey")
    return al.absent(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), big)


@query("sc5_business_days")
def _(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias(DATE)).distinct().where(F.date_trunc("week", DATE).cast("date") != F.col(DATE))
    return al.business_offset(days, days, 20).where("known IS NOT NULL").select(F.col(DATE).alias("report"), "known")


@query(
    "sc8_10_lists",
    "SELECT s_suppkey, 'Supplier, ' || CAST(s_nationkey AS VARCHAR) AS joined, 2 AS n FROM supplier WHERE s_suppkey % 4 < 3 UNION ALL SELECT s_suppkey, '', 0 FROM supplier WHERE s_suppkey % 4 = 3",
)
def _(spark, d):
    """Cells that hold lists in three notations, or nothing."""
    s = table(spark, d, "supplier").withColumn("cell", F.expr("""CASE s_suppkey % 4 WHEN 0 THEN '["Supplier", " ' || s_nationkey || '"]' WHEN 1 THEN "['Supplier', '" || s_nationkey || "']" WHEN 2 THEN ' Supplier ,, ' || s_nationkey END"""))
    names = results.parse_list("cell")
    return s.select("s_suppkey", results.join_list(names, ", ").alias("joined"), F.size(names).alias("n"))


# Search and selection.
@query(
    "se3_crowding",
    """SELECT id, front, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL THEN 1E9 ELSE round((CASE WHEN m1 > n1 THEN (b - a) / (m1 - n1) ELSE 0 END + CASE WHEN m2 > n2 THEN (d - c) / (m2 - n2) ELSE 0 END), 6) END AS crowding FROM (
      SELECT id, front, lag(f1) OVER (PARTITION BY front ORDER BY f1, id) AS a, lead(f1) OVER (PARTITION BY front ORDER BY f1, id) AS b, lag(f2) OVER (PARTITION BY front ORDER BY f2, id) AS c, lead(f2) OVER (PARTITION BY front ORDER BY f2, id) AS d,
        max(f1) OVER (PARTITION BY front) AS m1, min(f1) OVER (PARTITION BY front) AS n1, max(f2) OVER (PARTITION BY front) AS m2, min(f2) OVER (PARTITION BY front) AS n2
      FROM (SELECT c_custkey AS id, c_nationkey AS front, c_acctbal AS f1, CAST(c_custkey * 7919 % 1009 AS DOUBLE) AS f2 FROM customer) o) q""",
)
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("front"), F.col("c_acctbal").alias("f1"), (F.col("c_custkey") * 7919 % 1009).cast("double").alias("f2"))
    return selection.crowding_by_front(c, "front", ["f1", "f2"], "id").select("id", "front", F.round(F.least("crowding", F.lit(1e9)), 6).alias("crowding"))


# Windows of dates.
@query(
    "mt17_rolling",
    f"""WITH d AS (SELECT {DATE} AS day0, row_number() OVER (ORDER BY {DATE}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {DATE} FROM {{panel}}) q),
      b AS (SELECT min(CASE WHEN day0 >= TIMESTAMP '1995-01-01' THEN i END) AS a, min(CASE WHEN day0 >= TIMESTAMP '1997-01-01' THEN i END) AS t, max(n) AS n FROM d),
      w AS (SELECT CAST((d.i - b.t) / 26 AS INT) AS w, d.i, b.* FROM d CROSS JOIN b WHERE d.i >= b.t AND (d.i - b.t) % 26 = 0)
      SELECT w.w AS "window", s.day0 AS train_start, e.day0 AS train_end, f.day0 AS test_start, l.day0 AS test_end FROM w JOIN d s ON s.i = greatest(0, w.i - (w.t - w.a)) JOIN d e ON e.i = w.i - 5 JOIN d f ON f.i = w.i JOIN d l ON l.i = least(w.i + 26, w.n) - 1""",
    panel=True,
)
def _(spark, d):
    return folds.rolling_windows(cells(spark, d), "1995-01-01", "1997-01-01", folds.Rolling(26, 4))


@query(
    "mt18_split",
    f"""WITH d AS (SELECT {DATE}, row_number() OVER (ORDER BY {DATE}) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {DATE} FROM {{panel}}) q)
      SELECT part, min({DATE}) AS first_date, max({DATE}) AS last_date, count(*) AS dates FROM (SELECT {DATE}, CASE WHEN i <= CAST(floor(n * 0.7) AS BIGINT) THEN 'learn' WHEN i > CAST(floor(n * 0.7) AS BIGINT) + 4 THEN 'judge' END AS part FROM d) p WHERE part IS NOT NULL GROUP BY part""",
    panel=True,
)
def _(spark, d):
    a, b = folds.split(cells(spark, d), 0.7, 4)
    told = lambda df, part: df.select(DATE).distinct().agg(F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.count("*").alias("dates")).withColumn("part", F.lit(part))
    return told(a, "learn").unionByName(told(b, "judge"))


# Order book.
_TICKS = f"""SELECT ts AS {DATE}, CAST(user_id % 20 AS VARCHAR(9)) AS {NAME}, event_id, 100 + (event_id * 37 % 101) / 50.0E0 AS BP1, 100.02E0 + (event_id * 37 % 101) / 50.0E0 + (event_id % 7) / 100.0E0 AS SP1,
  {", ".join(f"CAST(event_id * {11 + 2 * k} % {97 + k} AS DOUBLE) AS BV{k}, CAST(event_id * {17 + 2 * k} % {89 + k} AS DOUBLE) AS SV{k}" for k in range(1, 6))} FROM events"""


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("events")
    return spark.sql(_TICKS)


def _measures_sql() -> str:
    depth = lambda s, n: " + ".join(f"{s}V{k}" for k in range(1, n + 1))
    ratio = lambda a, b: f"CASE WHEN {b} <> 0 THEN ({a}) / ({b}) END"
    first = ", ".join(f"{depth('B', n)} AS b{n}, {depth('S', n)} AS s{n}" for n in (1, 3, 5))
    lag = lambda c: f"lag({c}) OVER (PARTITION BY {NAME}, CAST({DATE} AS DATE) ORDER BY {DATE}, event_id)"
    return f"""SELECT *, {ratio('micro - ob_mid', 'ob_mid')} AS ob_micro_price_dev, near_b - near_s AS ob_book_shape_gap, {ratio('ob_net_bid_change_5', 'ob_total_depth_5')} AS ob_net_bid_change_5_ratio FROM (
      SELECT *, {ratio('SP1 - BP1', 'ob_mid')} AS ob_spread, b5 AS ob_bid_depth_5, s5 AS ob_ask_depth_5, b5 + s5 AS ob_total_depth_5, {", ".join(f"{ratio(f'b{n} - s{n}', f'(b{n} + s{n})')} AS ob_imbalance_{n}" for n in (1, 3, 5))},
        {ratio('SP1 * BV1 + BP1 * SV1', '(BV1 + SV1)')} AS micro, {ratio('BV1 + BV2', 'b5')} AS near_b, {ratio('SV1 + SV2', 's5')} AS near_s,
        {", ".join(f"b{n} - {lag(f'b{n}')} - (s{n} - {lag(f's{n}')}) AS ob_net_bid_change_{n}" for n in (1, 5))}
      FROM (SELECT *, (BP1 + SP1) / 2 AS ob_mid, {first} FROM ({_TICKS}) t WHERE strftime({DATE}, '%H:%M') BETWEEN '09:35' AND '11:30' OR strftime({DATE}, '%H:%M') BETWEEN '13:05' AND '15:00') a) b"""


def _book_sql() -> str:
    out = []
    for name, (lo, hi) in orderbook.SESSIONS.items():
        for m in orderbook.MEASURES:
            x = m if name == "full" else f"CASE WHEN strftime({DATE}, '%H:%M') BETWEEN '{lo}' AND '{hi}' THEN {m} END"
            skew = f"CASE WHEN count({x}) > 2 THEN CASE WHEN var_pop({x}) > 1E-20 THEN skewness({x}) ELSE 0 END END"
            out += [f"round(avg({x}) + 1.3E-10, 6) AS {m}_{name}_mean", f"round(stddev_samp({x}) + 1.3E-10, 6) AS {m}_{name}_std", f"round({skew} + 1.3E-8, 4) AS {m}_{name}_skew", f"round(max_by({x}, {{'a': {DATE}, 'b': event_id}}) FILTER (WHERE ({x}) IS NOT NULL) + 1.3E-10, 6) AS {m}_{name}_last", f"round(max({x}) + 1.3E-10, 6) AS {m}_{name}_max", f"round(min({x}) + 1.3E-10, 6) AS {m}_{name}_min"]
    return f"SELECT date_trunc('day', {DATE}) + INTERVAL 15 HOURS AS {DATE}, {NAME}, {', '.join(out)} FROM ({_measures_sql()}) m GROUP BY 1, 2"


@query("fe25_tick_measures", f"SELECT event_id, {', '.join(f'round({m} + 1.3E-10, 6) + 0.0E0 AS {m}' for m in orderbook.MEASURES)} FROM ({_measures_sql()}) m")
def _(spark, d):
    m = orderbook.tick_measures(al.sessions(_ticks(spark, d)), (DATE, "event_id"))
    return m.select("event_id", *[six(c) for c in orderbook.MEASURES])


@query("ag1_orderbook_days", _book_sql())
def _(spark, d):
    m = orderbook.tick_measures(al.sessions(_ticks(spark, d)), (DATE, "event_id"))
    days = orderbook.daily_book(m, order=(DATE, "event_id"))
    rounded = [f"round({c} + {'1.3E-8, 4' if c.endswith('_skew') else '1.3E-10, 6'}) AS {c}" for c in days.columns if c not in (DATE, NAME)]
    return days.selectExpr(DATE, NAME, *rounded)


@query(
    "fe27_28_book_composites",
    f"""SELECT {DATE}, {NAME}, round(no + io - so + 1.3E-10, 6) + 0.0E0 AS ob_open_buy_intent, round(ic + mc + nc + 1.3E-10, 6) + 0.0E0 AS ob_close_chase_pressure, round(sm + 2 * ss + 1.3E-10, 6) + 0.0E0 AS ob_liquidity_stress, round(ic - fm + 1.3E-10, 6) + 0.0E0 AS ob_close_buying_vs_day FROM (
      SELECT date_trunc('day', {DATE}) + INTERVAL 15 HOURS AS {DATE}, {NAME}, avg(ob_net_bid_change_5) FILTER (WHERE hm BETWEEN '09:35' AND '10:00') AS no, avg(ob_imbalance_5) FILTER (WHERE hm BETWEEN '09:35' AND '10:00') AS io, avg(ob_spread) FILTER (WHERE hm BETWEEN '09:35' AND '10:00') AS so,
        avg(ob_imbalance_5) FILTER (WHERE hm BETWEEN '14:35' AND '15:00') AS ic, avg(ob_micro_price_dev) FILTER (WHERE hm BETWEEN '14:35' AND '15:00') AS mc, avg(ob_net_bid_change_5) FILTER (WHERE hm BETWEEN '14:35' AND '15:00') AS nc,
        max(ob_spread) AS sm, stddev_samp(ob_spread) AS ss, avg(ob_imbalance_5) AS fm FROM (SELECT *, strftime({DATE}, '%H:%M') AS hm FROM ({_measures_sql()}) m) n GROUP BY 1, 2) q""",
)
def _(spark, d):
    names = ("ob_open_buy_intent", "ob_close_chase_pressure", "ob_liquidity_stress", "ob_close_buying_vs_day")
    days = orderbook.book_days(_ticks(spark, d), (DATE, "event_id"), keep=orderbook.KEPT)
    return days.select(DATE, NAME, *[six(c) for c in names])


# The panel builder.
_KEYS = f"SELECT {DATE} + INTERVAL 15 HOURS AS {DATE}, CAST({NAME} AS VARCHAR) AS {NAME}"


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.date_trunc("week", F.date_trunc("quarter", "l_shipdate")).alias(DATE), F.col("l_suppkey").cast("string").alias(NAME)).agg(F.sum("l_quantity").alias("shipped"), F.avg("l_tax").alias("rare"))


@query(
    "fe1_panel_builder",
    f"""WITH p AS (SELECT {DATE} + INTERVAL 15 HOURS AS {DATE}, CAST({NAME} AS VARCHAR) AS {NAME}, industry, tradeable, price, volume, tax, amount FROM {{panel}}),
      full_label AS (SELECT {DATE}, {NAME}, CASE WHEN price <> 0 THEN lead(price, 5) OVER (PARTITION BY {NAME} ORDER BY {DATE}) / price - 1 END AS label FROM p),
      k AS (SELECT * FROM p WHERE industry IN ('r0', 'r2')),
      r AS (SELECT date_trunc('week', date_trunc('quarter', l_shipdate)) + INTERVAL 15 HOURS AS {DATE}, CAST(l_suppkey AS VARCHAR) AS {NAME}, sum(l_quantity) AS shipped FROM lineitem GROUP BY 1, 2),
      u AS (SELECT {DATE}, {NAME} FROM k UNION SELECT {DATE}, {NAME} FROM r),
      n AS (SELECT u.{DATE}, u.{NAME}, r.shipped, row_number() OVER (PARTITION BY u.{NAME} ORDER BY u.{DATE}) AS i FROM u LEFT JOIN r ON u.{DATE} = r.{DATE} AND u.{NAME} = r.{NAME}),
      f AS (SELECT *, last_value(shipped IGNORE NULLS) OVER w AS v, max(CASE WHEN shipped IS NOT NULL THEN i END) OVER w AS s FROM n WINDOW w AS (PARTITION BY {NAME} ORDER BY {DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT k.{DATE}, k.{NAME}, k.industry, round(k.amount, 2) AS market_cap, round(k.price, 6) AS close, k.amount IS NOT NULL AS tradeable, round(l.label + 1.3E-10, 6) + 0.0E0 AS label, round(k.volume, 6) AS volume, round(k.tax, 6) AS tax, round(CASE WHEN f.i - f.s <= 20 THEN f.v END, 6) AS shipped
      FROM k JOIN full_label l ON k.{DATE} = l.{DATE} AND k.{NAME} = l.{NAME} LEFT JOIN f ON k.{DATE} = f.{DATE} AND k.{NAME} = f.{NAME}""",
    panel=True,
)
def _(spark, d):
    p = written(cells(spark, d), "weeks")  # the sources are all cut from it
    some = lambda *c: p.select(DATE, NAME, *c)
    built = builder.build_panel(
        builder.Values(some("industry")), builder.Values(some("amount")), [builder.Factors(some("volume", "tax", F.lit(1.0).alias("flat"), "industry"), "price_table"), builder.Factors(_quarters(spark, d), "income_statement", exclude=["rare"], limit=20)],
        groups=["r0", "r2"], close=builder.Values(some("price")), horizon=5, choice=builder.Choice(least_uniques=5, other=0.1, coverage={}),
    )
    return built.panel.select(DATE, NAME, "industry", F.round("market_cap", 2).alias("market_cap"), F.round("close", 6).alias("close"), "tradeable", six("label"), *[F.round(c, 6).alias(c) for c in ("volume", "tax", "shipped")])


# Regressions by another way: controls made orthogonal one after another.
def _gram_schmidt(y: str, controls: list[str]) -> str:
    known = " AND ".join(f"{c} IS NOT NULL" for c in (y, *controls))
    last = f"SELECT {DATE}, {NAME}, {y}, {', '.join(controls)}, count(*) OVER (PARTITION BY {DATE}) AS n FROM base WHERE {known}"
    left = [y, *controls]
    last = f"SELECT {DATE}, {NAME}, n, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY {DATE}) AS {c}' for c in left)} FROM ({last}) q"
    for c in controls:
        left.remove(c)
        part = lambda v, c=c: f"{v} - CASE WHEN sum({c} * {c}) OVER (PARTITION BY {DATE}) > 1E-12 THEN sum({v} * {c}) OVER (PARTITION BY {DATE}) / sum({c} * {c}) OVER (PARTITION BY {DATE}) ELSE 0 END * {c} AS {v}"
        last = f"SELECT {DATE}, {NAME}, n, {', '.join(part(v) for v in left)} FROM ({last}) q"
    return f"SELECT {DATE}, {NAME}, round(CASE WHEN n >= {len(controls) + 2} THEN {y} END + 1.3E-10, 5) + 0.0E0 AS residual FROM ({last}) q"


@query("rg3_orthogonal_controls", f"WITH base AS (SELECT {DATE}, {NAME}, ln(price) AS y, size, tax, discount FROM {{panel}} WHERE tradeable) {_gram_schmidt('y', ['size', 'discount', 'tax'])}", panel=True)
def _(spark, d):
    df = cells(spark, d).where("tradeable").withColumn("y", F.log("price"))
    return regression.residuals(df, "y", ["size", "discount", "tax"], ridge=0.0).select(DATE, NAME, (F.round(F.col("residual") + 1.3e-10, 5) + F.lit(0.0)).alias("residual"))


def _ridge(y: str, controls: list[str], ridge: str, base: str, n: str = "count(*) OVER (PARTITION BY {d})", least: str = "") -> str:
    """The residual with a ridge, orthogonally: each control gets a row a date of its own that holds the ridge's root, and all are taken out one after another."""
    names, d = [y, *controls], DATE
    centred = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {d}) AS {c}" for c in names)
    last = f"SELECT {d}, {NAME}, {n.format(d=d)} AS n, {centred} FROM ({base}) q0"
    own = " UNION ALL ".join(
        f"SELECT DISTINCT {d}, NULL AS {NAME}, n, 0.0E0 AS {y}, {', '.join(f'sqrt({ridge})' if x == c else '0.0E0' for x in controls)} FROM centred".replace(" FROM", " FROM", 1) for c in controls
    )
    last = f"WITH centred AS ({last}) SELECT {d}, {NAME}, n, {', '.join(names)} FROM centred UNION ALL {own}"
    left = list(names)
    for c in controls:
        left.remove(c)
        part = lambda v, c=c: f"{v} - CASE WHEN sum({c} * {c}) OVER (PARTITION BY {d}) > 1E-12 THEN sum({v} * {c}) OVER (PARTITION BY {d}) / sum({c} * {c}) OVER (PARTITION BY {d}) ELSE 0 END * {c} AS {v}"
        last = f"SELECT {d}, {NAME}, n, {', '.join(part(v) for v in left)} FROM ({last}) q"
    enough = least or str(len(controls) + 2)
    return f"SELECT {d}, {NAME}, CASE WHEN n >= {enough} THEN {y} END AS residual FROM ({last}) q WHERE {NAME} IS NOT NULL"


_STYLES = ["size", "discount", "tax"]


def _with_all_rows(residual: str, rows: str) -> str:
    """Residuals next to all rows of the panel, rounded."""
    return f"SELECT p.{DATE}, p.{NAME}, round(r.residual + 1.3E-10, 6) + 0.0E0 AS residual FROM ({rows}) p LEFT JOIN ({residual}) r ON p.{DATE} = r.{DATE} AND p.{NAME} = r.{NAME}"


def _known(columns: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


@query(
    "rg3_many_controls",
    _with_all_rows(_ridge("y", [*_STYLES, "volume"], "1E-6", f"SELECT {DATE}, {NAME}, ln(price) AS y, size, discount, tax, volume FROM {{panel}} WHERE {_known(['price', *_STYLES, 'volume'])}"), f"SELECT {DATE}, {NAME} FROM {{panel}}"),
    panel=True,
)
def _(spark, d):
    """Joint residual on four controls, with a ridge."""
    df = cells(spark, d).withColumn("y", F.log("price"))
    return regression.residuals(df, "y", [*_STYLES, "volume"]).select(DATE, NAME, six("residual"))


def _dynamic_sql() -> str:
    """Controls that aren't picked are 0 everywhere and take nothing out; what isn't known of them doesn't matter."""
    daily = ", ".join(
        f"CASE WHEN count(y) FILTER (WHERE {s} IS NOT NULL) >= 3 AND var_pop(y) FILTER (WHERE {s} IS NOT NULL) > 1E-14 AND var_pop({s}) FILTER (WHERE y IS NOT NULL) > 1E-14 THEN corr(y, {s}) END AS {s}" for s in _STYLES
    )
    means = " UNION ALL ".join(f"SELECT '{s}' AS style, abs(avg({s})) AS c FROM daily" for s in _STYLES)
    flags = ", ".join(f"coalesce(max(CASE WHEN style = '{s}' THEN 1.0E0 END), 0.0E0) AS f_{s}" for s in _STYLES)
    masked = ", ".join(f"CASE WHEN f_{s} > 0 THEN {s} ELSE 0.0E0 END AS {s}" for s in _STYLES)
    known = " AND ".join(f"(f_{s} = 0 OR {s} IS NOT NULL)" for s in _STYLES)
    base = f"SELECT {DATE}, {NAME}, y, {masked} FROM p, flags WHERE y IS NOT NULL AND {known}"
    number = " + ".join(f"f_{s}" for s in _STYLES)
    some = _ridge("y", _STYLES, "1E-6", base, least=f"(SELECT {number} FROM flags) + 2")
    return f"""WITH p AS (SELECT {DATE}, {NAME}, ln(price) AS y, {', '.join(_STYLES)} FROM {{panel}}),
      daily AS (SELECT {DATE}, {daily} FROM p GROUP BY {DATE}),
      picked AS (SELECT style FROM ({means}) m WHERE c > 0.3 ORDER BY c DESC, style LIMIT 2),
      flags AS (SELECT {flags} FROM picked),
      part AS ({some})
      {_with_all_rows(f"SELECT p.{DATE}, p.{NAME}, CASE WHEN (SELECT {number} FROM flags) = 0 THEN p.y ELSE s.residual END AS residual FROM p LEFT JOIN part s ON p.{DATE} = s.{DATE} AND p.{NAME} = s.{NAME}", "SELECT * FROM p")}"""


@query("rg5_dynamic_styles", _dynamic_sql(), panel=True)
def _(spark, d):
    """Residual on the styles most correlated with the factor."""
    df = cells(spark, d).withColumn("y", F.log("price"))
    out, _ = regression.neutralise_dynamic(df, "y", _STYLES)
    return out.select(DATE, NAME, six("residual"))


@query("rg5_weak_styles", _dynamic_sql().replace("c > 0.3", "c > 0.01").replace("LIMIT 2", "LIMIT 1"), panel=True)
def _(spark, d):
    """As before, with a threshold that some style passes."""
    df = cells(spark, d).withColumn("y", F.log("price"))
    out, _ = regression.neutralise_dynamic(df, "y", _STYLES, threshold=0.01, most=1)
    return out.select(DATE, NAME, six("residual"))


@query(
    "rg8_styles_then_industry",
    f"WITH base AS (SELECT {DATE}, {NAME}, ln(price) AS y, size, tax, discount FROM {{panel}} WHERE tradeable AND industry IS NOT NULL) SELECT q.{DATE}, q.{NAME}, round(q.residual0 - avg(q.residual0) OVER (PARTITION BY q.{DATE}, p.industry) + 1.3E-10, 5) + 0.0E0 AS residual FROM ({_gram_schmidt('y', ['size', 'discount', 'tax']).replace('round(CASE', '(CASE').replace(' + 1.3E-10, 5) + 0.0E0 AS residual', ') AS residual0')}) q JOIN {{panel}} p ON q.{DATE} = p.{DATE} AND q.{NAME} = p.{NAME} WHERE q.residual0 IS NOT NULL",
    panel=True,
)
def _(spark, d):
    df = cells(spark, d).where("tradeable").withColumn("y", F.log("price"))
    out = regression.neutralise_full(df, "y", ["size", "discount", "tax"], jointly=False, restandardise=True, ridge=0.0)
    return out.where("residual IS NOT NULL").select(DATE, NAME, (F.round(F.col("residual") + 1.3e-10, 5) + F.lit(0.0)).alias("residual"))


@query("rg10_size_field", f"WITH base AS (SELECT {DATE}, {NAME}, ln(price) AS y, ln(1 + amount) AS s FROM {{panel}} WHERE tradeable) {_gram_schmidt('y', ['s'])}", panel=True)
def _(spark, d):
    df = cells(spark, d).where("tradeable").withColumns({"y": F.log("price"), "market_cap": F.col("amount")})
    return regression.size_neutral(df, "y", ridge=0.0).select(DATE, NAME, (F.round(F.col("residual") + 1.3e-10, 5) + F.lit(0.0)).alias("residual"))


# Sources and layout.
@query("io6_8_wide_and_long", f"SELECT {DATE}, CAST({NAME} AS VARCHAR) AS {NAME}, price FROM {{panel}}", panel=True)
def _(spark, d):
    wide = tables.long_to_wide(cells(spark, d).select(DATE, NAME, "price"), "price")
    return tables.wide_to_long(wide, "price")


@query("io7_value_source", f"SELECT {DATE} + INTERVAL 15 HOURS AS {DATE}, CAST({NAME} AS VARCHAR) AS {NAME}, tax AS rate FROM {{panel}}", panel=True)
def _(spark, d):
    return builder.Values(cells(spark, d).select(DATE, NAME, "tax", "volume"), "tax").read("rate")


@query("io8_factor_table", f"SELECT {DATE} + INTERVAL 15 HOURS AS {DATE}, CAST({NAME} AS VARCHAR) AS {NAME}, price AS f_price, tax AS f_tax FROM {{panel}}", panel=True)
def _(spark, d):
    return builder.Factors(cells(spark, d).select(DATE, NAME, "price", "tax", "volume", "industry", "label"), "any", exclude=["volume"], prefix="f_").read()


@query("pf1_3_validation", "SELECT 'close' AS panel, TRUE AS valid UNION ALL SELECT 'midnight', FALSE UNION ALL SELECT 'twice', FALSE UNION ALL SELECT 'wide', TRUE")
def _(spark, d):
    p = written(cells(spark, d).select(DATE, NAME, "price"), "panel")  # nine passes read it
    shut = at_close(p)
    told = [("close", validate_panel(shut, False)), ("midnight", validate_panel(p, False)), ("twice", validate_panel(shut.unionByName(shut), False)), ("wide", validate_wide(tables.long_to_wide(shut, "price"), False))]
    return spark.createDataFrame(told, "panel string, valid boolean")


@query(
    "rg7_jointly_full",
    f"WITH base AS (SELECT {DATE}, {NAME}, y - avg(y) OVER w AS y, size - avg(size) OVER w AS size, discount - avg(discount) OVER w AS discount, tax - avg(tax) OVER w AS tax FROM (SELECT *, ln(price) AS y FROM {{panel}} WHERE tradeable) q WINDOW w AS (PARTITION BY {DATE}, industry)) {_gram_schmidt('y', ['size', 'discount', 'tax'])}",
    panel=True,
)
def _(spark, d):
    df = cells(spark, d).where("tradeable").withColumn("y", F.log("price"))
    out = regression.neutralise_full(df, "y", ["size", "discount", "tax"], ridge=0.0)
    return out.select(DATE, NAME, (F.round(F.col("residual") + 1.3e-10, 5) + F.lit(0.0)).alias("residual"))


# Contracts of many rows: every kind of event is one, and its windows run in blocks of time.
_EVENT_PANEL = f"SELECT ts AS {DATE}, event_type AS {NAME}, sum(value) AS value FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ts, event_type"


def _long_columns(p: Layers) -> dict[str, str]:
    """Windows, shifts both ways, walks, chains of them, and values carried over any number of rows."""
    rare = p.let("CASE WHEN value > 200 THEN value END")
    return {DATE: DATE, NAME: NAME, "before": ts.delay(p, "value", 60), "mean": ts.ts_mean(p, "value", 120), "median": ts.ts_median(p, "value", 20), "decayed": ts.decay_linear(p, "value", 20),
            "later": p.let(f"lead(value, 60) OVER ({p.T})"), "spread_of_mean": ts.ts_std(p, ts.ts_mean(p, "value", 20), 60), "rare": ts.ffill(p, rare), "rare_recent": ts.ffill(p, rare, 30),
            "mean_of_rare": ts.ts_mean(p, ts.ffill(p, rare), 20)}


def _long_text() -> str:
    p = SqlText(f"ticks AS ({_EVENT_PANEL})", "ticks", [DATE, NAME, "value"])
    return p.select(_long_columns(p))


@query("ts_long_contracts", _long_text())
def _(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events")
    p = BlockedPanel(spark.sql(_EVENT_PANEL))
    return p.select(_long_columns(p))


# Order lines written as record batches and read again, three of their columns.
@query("io2_record_batches", "SELECT l_shipdate, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_shipdate, l_suppkey, l_returnflag")
def _(spark, d):
    path = f"{shared_folder(spark)}/quillon/batches-{uuid.uuid4().hex}"
    write_batches(table(spark, d, "lineitem"), path)
    return read_batches(spark, path, ["l_returnflag", "l_suppkey", "l_shipdate"]).groupBy("l_shipdate", "l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
