"""Registered queries over plain tables: daily aggregates of ticks, frequencies, selections, ranking by several objectives.

Each is one SQL text with the few functions in which engines differ filled in, or a DataFrame function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import dominance, lasso
from quillon.plans.layers import DATE, NAME
from quillon.plans.panel import weekly_panel

# Functions in which engines differ: Spark, DuckDB.
_SPARK = {
    "tokens": "explode(split({0}, ' '))", "percentile": "percentile({0}, {1})", "hhmm": "date_format({0}, 'HH:mm')", "ymd": "date_format({0}, 'yyyyMMdd')", "last": "max_by({0}, {1}) FILTER (WHERE {0} IS NOT NULL)",
    "parse": "to_timestamp({0}, 'yyyyMMdd')", "suffix": "regexp_extract({0}, '([0-9]+)$', 1)", "json": "get_json_object({0}, '$.{1}')", "sorted": "array_join(array_sort(collect_list({0})), ' + ')",
}
_DUCK = {
    "tokens": "unnest(string_split({0}, ' '))", "percentile": "quantile_cont({0}, {1})", "hhmm": "strftime({0}, '%H:%M')", "ymd": "strftime({0}, '%Y%m%d')", "last": "max_by({0}, {1}) FILTER (WHERE {0} IS NOT NULL)",
    "parse": "strptime({0}, '%Y%m%d')", "suffix": "regexp_extract({0}, '([0-9]+)$', 1)", "json": "json_extract_string({0}, '$.{1}')", "sorted": "array_to_string(list_sort(list({0})), ' + ')",
}

SQL: dict[str, Callable[[Callable[..., str]], str]] = {}


def sql_query(name: str):
    def add(f):
        SQL[name] = f
        return f

    return add


@sql_query("ag1_daily_ticks")
def _(f):
    """Ticks to days by session: mean, deviation, bias-corrected skew, last known, extremes."""
    out = []
    for s, cond in (("day", "TRUE"), ("am", f"{f('hhmm', 'ts')} < '11:30'"), ("close", f"{f('hhmm', 'ts')} >= '14:30'")):
        v = f"CASE WHEN {cond} THEN value END"
        n, m = f"count({v})", f"avg({v})"
        m3 = f"(avg(CASE WHEN {cond} THEN value * value * value END) - 3 * {m} * avg(CASE WHEN {cond} THEN value * value END) + 2 * {m} * {m} * {m})"
        skew = f"CASE WHEN {n} > 2 AND var_pop({v}) > 1E-12 THEN {m3} / (var_pop({v}) * sqrt(var_pop({v}))) * sqrt({n} * ({n} - 1.0E0)) / ({n} - 2) END"
        out += [f"round({m}, 6) AS {s}_mean", f"round(stddev_samp({v}), 6) AS {s}_std", f"round({skew}, 4) AS {s}_skew", f"max({v}) AS {s}_max", f"min({v}) AS {s}_min", f"{f('last', f'({v})', 'event_id')} AS {s}_last"]
    return f"SELECT CAST(ts AS DATE) AS day0, user_id, {', '.join(out)} FROM events GROUP BY CAST(ts AS DATE), user_id"


@sql_query("ag3_field_frequency")
def _(f):
    return f"SELECT token, count(*) AS n, count(DISTINCT p_partkey) AS parts, sum(CASE WHEN p_size > 25 THEN 1.0E0 ELSE 0.0E0 END) AS large, round(count(*) * 1.0E0 / sum(count(*)) OVER (), 6) AS share FROM (SELECT p_partkey, p_size, {f('tokens', 'p_name')} AS token FROM part) q GROUP BY token"


@sql_query("ag4_grouped_frequency")
def _(f):
    q = f"(SELECT p_partkey, p_brand, {f('tokens', 'p_name')} AS token FROM part) q"
    return f"SELECT 'token' AS level0, token AS k, count(*) AS n FROM {q} GROUP BY token UNION ALL SELECT 'brand', p_brand, count(*) FROM {q} GROUP BY p_brand UNION ALL SELECT 'both', p_brand || '/' || token, count(*) FROM {q} GROUP BY p_brand || '/' || token"


@sql_query("ag5_json_occurrences")
def _(f):
    return f"SELECT event_type, {f('json', 'props', 'k')} AS k, count(*) AS n FROM events GROUP BY event_type, {f('json', 'props', 'k')}"


@sql_query("ag8_combo_statistics")
def _(f):
    combo = f"SELECT o_custkey, {f('sorted', 'o_orderpriority')} AS combo, avg(o_totalprice) AS v FROM (SELECT DISTINCT o_custkey, o_orderpriority, o_totalprice FROM orders) q GROUP BY o_custkey"
    return f"SELECT combo, count(*) AS n, round(avg(v) + 1.3E-5, 2) AS mean, round({f('percentile', 'v', 0.5)} + 1.3E-5, 2) AS median FROM ({combo}) q GROUP BY combo HAVING count(*) > 1"


@sql_query("ag9_selection_summary")
def _(f):
    return "SELECT c_mktsegment, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1.0E0 ELSE 0.0E0 END) AS positive, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment"


@sql_query("ag10_five_numbers")
def _(f):
    return "SELECT event_type, " + ", ".join(f"round({f('percentile', 'value', q)}, 6) AS q{int(100 * q)}" for q in (0, 0.25, 0.5, 0.75, 1)) + " FROM events GROUP BY event_type"


@sql_query("ag12_unpivot")
def _(f):
    return "SELECT s_suppkey, 'balance' AS metric, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier"


@sql_query("ag13_category_matrix")
def _(f):
    kinds = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return "SELECT o_custkey, " + ", ".join(f"max(CASE WHEN o_orderpriority = '{k}' THEN 1 ELSE 0 END) AS k{i}" for i, k in enumerate(kinds)) + " FROM orders GROUP BY o_custkey"


@sql_query("jn12_lookup")
def _(f):
    return "SELECT s.s_suppkey, coalesce(n.n_name, 'unknown') AS nation FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey"


@sql_query("jn13_cooccurrence")
def _(f):
    q = f"(SELECT DISTINCT p_partkey, token FROM (SELECT p_partkey, {f('tokens', 'p_name')} AS token FROM part) t)"
    return f"SELECT a.token AS a, b.token AS b, count(*) AS n FROM {q} a JOIN {q} b ON a.p_partkey = b.p_partkey GROUP BY a.token, b.token"


@sql_query("so1_2_top_results")
def _(f):
    return "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 20"


@sql_query("so3_top_k_per_group")
def _(f):
    return "SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) q WHERE i <= 3"


@sql_query("st1_union_keep_first")
def _(f):
    q = "SELECT o_custkey AS k, 0 AS source, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 1, o_totalprice FROM orders WHERE o_orderstatus <> 'F'"
    return f"SELECT k, source, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source, v) AS i FROM ({q}) u) w WHERE i = 1"


@sql_query("st2_keep_last")
def _(f):
    return "SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) q WHERE i = 1"


@sql_query("st3_intersection")
def _(f):
    return "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"


@sql_query("st4_difference")
def _(f):
    return "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"


@sql_query("sc1_4_dates")
def _(f):
    return f"SELECT o_orderkey, {f('ymd', 'o_orderdate')} AS ymd, {f('parse', f('ymd', 'o_orderdate'))} + INTERVAL 15 HOURS AS close_at, date_trunc('month', o_orderdate) + INTERVAL 0 DAYS AS month0 FROM orders"


@sql_query("sc5_business_days")
def _(f):
    dow = "(CAST(date_trunc('week', d) AS DATE) <> CAST(d AS DATE))"
    return f"WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), work AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM days WHERE {dow}) SELECT a.d AS report, b.d AS known FROM work a JOIN work b ON b.i = a.i + 20"


@sql_query("sc6_7_names")
def _(f):
    return f"SELECT s_suppkey, {f('suffix', 's_name')} AS number0, CASE WHEN lower(s_name) LIKE '%supplier%' THEN 'supplier' ELSE 'other' END AS kind FROM supplier"


_OBJECTIVES = "SELECT o_custkey AS id, round(avg(o_totalprice), 2) AS f1, CAST(count(*) AS DOUBLE) AS f2 FROM orders GROUP BY o_custkey"


@sql_query("se1_2_pareto_front")
def _(f):
    """Candidates that none other dominates: with the best f1 of all with a larger f2, and of those with the same f2, one window each instead of all pairs."""
    by = f"SELECT f2, max(f1) AS best FROM ({_OBJECTIVES}) o GROUP BY f2"
    above = f"SELECT f2, best, max(best) OVER (ORDER BY f2 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS higher FROM ({by}) b"
    return f"SELECT o.id, o.f1, o.f2 FROM ({_OBJECTIVES}) o JOIN ({above}) a ON o.f2 = a.f2 WHERE o.f1 = a.best AND (a.higher IS NULL OR o.f1 > a.higher)"


@sql_query("se3_crowding")
def _(f):
    return f"""SELECT id, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL THEN -1 ELSE round((b - a) / (m1 - n1) + (d - c) / (m2 - n2), 6) END AS distance FROM (
      SELECT id, lag(f1) OVER (ORDER BY f1, id) AS a, lead(f1) OVER (ORDER BY f1, id) AS b, lag(f2) OVER (ORDER BY f2, id) AS c, lead(f2) OVER (ORDER BY f2, id) AS d,
        max(f1) OVER () AS m1, min(f1) OVER () AS n1, max(f2) OVER () AS m2, min(f2) OVER () AS n2 FROM ({_OBJECTIVES}) o) q"""


def _views(spark: SparkSession, sf_dir: str) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _on_spark(f) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir)
        return spark.sql(f(lambda k, *a: _SPARK[k].format(*a)))

    return run


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql(f"SELECT CAST(id AS BIGINT) AS id, CAST(f1 AS DOUBLE) AS f1, f2 FROM ({_OBJECTIVES}) o")


def se1_2_pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that none other dominates."""
    return dominance.with_fronts(_candidates(spark, sf_dir), ["f1", "f2"]).where("front = 0").select("id", "f1", "f2")


def se4_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts and crowding of all candidates, ranked in cells."""
    r = dominance.ranked(_candidates(spark, sf_dir), ["f1", "f2"], "id")
    return r.select("id", "front", F.least("crowding", F.lit(1e9)).alias("crowding")).orderBy("front", F.desc("crowding"), "id")


def se6_elites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the largest id's number of candidates, by whole fronts and then by crowding."""
    c = _candidates(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count() // 5
    return dominance.elites(c, ["f1", "f2"], n, "id").select("id", "front")


#: The first engine rounds a double as it is written in decimals; the second is told to.
_SAME_OBJECTIVES = _OBJECTIVES.replace("round(avg(o_totalprice), 2)", "CAST(round(CAST(CAST(sum(o_totalprice) / count(*) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)")
#: The longest chain of candidates that dominate one another tells the front: level by level, what some candidate of the level before dominates.
_FRONTS = f"""o AS (SELECT CAST(id AS BIGINT) AS id, f1, f2 FROM ({_SAME_OBJECTIVES}) x),
  p AS (SELECT DISTINCT f1, f2 FROM o),
  chain AS (SELECT f1, f2, 0 AS depth FROM p UNION SELECT q.f1, q.f2, c.depth + 1 FROM chain c JOIN p q ON c.f1 >= q.f1 AND c.f2 >= q.f2 AND (c.f1 > q.f1 OR c.f2 > q.f2)),
  r AS (SELECT o.id, o.f1, o.f2, f.front FROM o JOIN (SELECT f1, f2, max(depth) AS front FROM chain GROUP BY f1, f2) f USING (f1, f2)),
  n AS (
    SELECT *, lag(f1) OVER a AS b1, lead(f1) OVER a AS a1, lag(f2) OVER b AS b2, lead(f2) OVER b AS a2,
      max(f1) OVER c - min(f1) OVER c AS w1, max(f2) OVER c - min(f2) OVER c AS w2
    FROM r WINDOW a AS (PARTITION BY front ORDER BY f1, id), b AS (PARTITION BY front ORDER BY f2, id), c AS (PARTITION BY front)),
  ranked AS (
    SELECT id, front, CASE WHEN b1 IS NULL OR a1 IS NULL OR b2 IS NULL OR a2 IS NULL THEN 1E9
      ELSE CASE WHEN w1 > 0 THEN (a1 - b1) / w1 ELSE 0 END + CASE WHEN w2 > 0 THEN (a2 - b2) / w2 ELSE 0 END END AS crowding FROM n)"""
_SELECTION_SQL = {
    "se4_selection": f"WITH RECURSIVE {_FRONTS} SELECT id, CAST(front AS INTEGER) AS front, crowding FROM ranked",
    "se6_elites": f"""WITH RECURSIVE {_FRONTS} SELECT id, CAST(front AS INTEGER) AS front FROM ranked
      QUALIFY row_number() OVER (ORDER BY front, crowding DESC, id) <= (SELECT count(*) // 5 FROM customer)""",
}


def se16_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a Lasso keeps for the label, with expanding date folds."""
    p = weekly_panel(spark, sf_dir)
    return lasso.select_fields(p.frame([]), ["price", "volume", "discount", "tax", "size"], "label", parts=p.parts)


def se12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short seeded search over programs."""
    from quillon.operators.search import SearchConfig, search

    p = weekly_panel(spark, sf_dir)
    found = search(p, ["price", "volume", "discount"], SearchConfig(population=6, generations=1, max_depth=3, max_size=12, windows=(5,)))
    return spark.createDataFrame([(f.expression, f.program, f.ic, f.ir, f.coverage, f.front) for f in found], "expression string, program_json string, rank_ic double, rank_ir double, coverage double, front int")


def _gene_search(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A short seeded search on dates before 1997, then the same genes on later dates in the direction found."""
    from quillon.operators import evolve as ev
    from quillon.plans.rules import FieldRule, Sampler

    sampler = Sampler({
        "price": FieldRule("currency", "market_value", "valuation", "pv_momentum", log=True, pct=True),
        "amount": FieldRule("currency", "revenue", "profitability", "pv_volume", log=True, diff=True),
        "volume": FieldRule("turnover", family="liquidity", kind="pv_volume"),
        "discount": FieldRule(family="quality", kind="pv_crowding", direction=-1),
        "tax": FieldRule(family="leverage", kind="pv_crowding"),
    })
    kind = ev.structured_kind(sampler) if name == "structured" else ev.behaviour_kind(sampler, name == "tree")
    p, cut = weekly_panel(spark, sf_dir), "TIMESTAMP '1997-01-01'"
    found = ev.evolve(p, kind, ev.Sizes(6, 1, size_weight=0.001 if name == "tree" else 0.0), where=f"{DATE} < {cut}")
    later = {kind.key(e.candidate): (e.score, ok) for e, ok in ev.validate(p, kind, found, where=f"{DATE} >= {cut}")}
    rows = [(str(e.candidate), e.score.ic, e.score.ir, e.score.coverage, e.score.direction, e.front, later[kind.key(e.candidate)][0].ic, later[kind.key(e.candidate)][1]) for e in found]
    return spark.createDataFrame(rows, "expression string, rank_ic double, rank_ir double, coverage double, direction int, front int, later_ic double, passed boolean")


def se12_structured_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gene_search(spark, sf_dir, "structured")


def se12_behaviour_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gene_search(spark, sf_dir, "behaviour")


def se12_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gene_search(spark, sf_dir, "tree")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _on_spark(f) for k, f in SQL.items()} | {f.__name__: f for f in (se1_2_pareto_front, se4_selection, se6_elites, se12_search, se12_structured_search, se12_behaviour_search, se12_tree_search, se16_lasso)}


def oracle_sql() -> dict[str, str]:
    return {k: f(lambda k, *a: _DUCK[k].format(*a)) for k, f in SQL.items()} | _SELECTION_SQL
