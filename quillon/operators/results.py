"""Analysis of search results: filters, what genes and programs are made of, frequencies, summaries of columns and panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.json_tree import json_nodes
from quillon.plans.layers import DATE, NAME

SLOT = "struct<slot:string,field:string,transform:string,direction:int>"
CONDITION = "struct<field:string,kind:string,threshold:double,transform:string>"


def metric_filter(results: DataFrame, least: Mapping[str, float], passed: str | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Rows whose named metrics are larger than given in absolute value; of a flag column only true rows; one row a key.

    Metrics and flags that the table doesn't have are not asked for.
    """
    out = results
    for c, v in least.items():
        if c in results.columns:
            out = out.where(F.abs(F.col(c)) > v)
    if passed and passed in results.columns:
        out = out.where(F.col(passed))
    return out.dropDuplicates(list(key)) if key else out


def high_ic(results: DataFrame, ic: str, ir: str, least_ic: float = 0.05, least_ir: float = 0.30) -> DataFrame:
    """Rows with both metrics above their bounds, best first."""
    return results.where((F.col(ic) > least_ic) & (F.col(ir) > least_ir)).orderBy(F.desc(ic), F.desc(ir))


def gene_occurrences(results: DataFrame, gene_id: str, slots: str = "gene_slots", conditions: str = "gene_conditions", keep: Sequence[str] = ()) -> DataFrame:
    """(gene_id, kept columns, place, slot, field, transform): a row for every field that a gene's JSON slots and conditions name. Cells that are no JSON give none."""
    s = F.from_json(slots, f"array<{SLOT}>")
    c = F.from_json(conditions, f"array<{CONDITION}>")
    every = F.concat(
        F.transform(F.coalesce(s, F.array().cast(f"array<{SLOT}>")), lambda x: F.struct(F.lit("slot").alias("place"), x["slot"].alias("slot"), x["field"].alias("field"), x["transform"].alias("transform"))),
        F.transform(F.coalesce(c, F.array().cast(f"array<{CONDITION}>")), lambda x: F.struct(F.lit("condition").alias("place"), x["kind"].alias("slot"), x["field"].alias("field"), x["transform"].alias("transform"))),
    )
    return results.select(F.col(gene_id).alias("gene_id"), *keep, F.explode(every).alias("o")).where("o.field IS NOT NULL").select("gene_id", *keep, "o.*")


def program_usage(results: DataFrame, gene_id: str, program: str = "program_json", op: str = "op", field: str = "field") -> DataFrame:
    """(gene_id, kind, name, n): operators and fields of each program's JSON, strings that stand under those names at any depth, and how often it uses them."""
    nodes = json_nodes(results.withColumn("gene_id", F.col(gene_id)), program, ["gene_id"])
    used = nodes.where(F.col("name").isin(op, field) & (F.col("kind") == "string"))
    kind = F.when(F.col("name") == op, "operator").otherwise("field")
    return used.groupBy("gene_id", kind.alias("kind"), F.col("value").alias("name")).agg(F.count("*").alias("n"))


def operators_in(expression: str | Column) -> Column:
    """Names that an expression text calls, in order."""
    c = F.col(expression) if isinstance(expression, str) else expression
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))


def fields_in(expression: str | Column) -> Column:
    """Names that an expression text mentions without calling them, in order."""
    c = F.col(expression) if isinstance(expression, str) else expression
    return F.regexp_extract_all(c, F.lit(r"\b([A-Za-z_]\w*+)(?!\s*\()"), F.lit(1))


def expression_usage(results: DataFrame, expression: str = "expression") -> DataFrame:
    """(kind, name, n, expressions): operators and fields of expression texts, how often and in how many texts they stand."""
    named = lambda c, kind: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    used = results.select(F.col(expression).alias("e"), F.explode(F.concat(named(operators_in(expression), "operator"), named(fields_in(expression), "field"))).alias("u"))
    return used.groupBy("u.kind", "u.name").agg(F.count("*").alias("n"), F.count_distinct("e").alias("expressions"))


def slot_usage(results: DataFrame, mode: str, slots: str = "gene_slots") -> DataFrame:
    """(mode, slot, trees, operators): how many genes of a mode fill a slot with a tree, and the operators those trees call."""
    s = F.explode(F.from_json(slots, f"array<{SLOT}>"))
    each = results.select(F.col(mode).alias("mode"), s.alias("s")).where(F.instr("s.field", "(") > 0)
    return each.groupBy("mode", "s.slot").agg(F.count("*").alias("trees"), F.sum(F.size(operators_in(F.col("s.field")))).alias("operators"))


def frequency(rows: DataFrame, by: Sequence[str], distinct: str | None = None, where: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows by some columns: n, distinct values of another column, rows for which named conditions hold, and the share of all."""
    counts = [F.count("*").alias("n")]
    if distinct:
        counts.append(F.count_distinct(distinct).alias("distinct_n"))
    counts += [F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in (where or {}).items()]
    out = rows.groupBy(*by).agg(*counts)
    return out.crossJoin(rows.agg(F.count("*").alias("_all"))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")  # one row on that side


def frequency_levels(rows: DataFrame, levels: Mapping[str, Sequence[str]], separator: str = "/") -> DataFrame:
    """(level, k, n, share): one frequency table for each named combination of columns, all in one pass over the rows."""
    columns = list(dict.fromkeys(chain.from_iterable(levels.values())))
    keys = [F.struct(F.lit(name).alias("level"), F.concat_ws(separator, *[F.col(c).cast("string") for c in cols]).alias("k")) for name, cols in levels.items()]
    each = rows.select(*columns).select(F.explode(F.array(*keys)).alias("x"))
    counted = each.groupBy("x.level", "x.k").agg(F.count("*").alias("n"))
    totals = counted.groupBy("level").agg(F.sum("n").alias("_all"))
    return counted.join(totals, "level").select("level", "k", "n", (F.col("n") / F.col("_all")).alias("share"))


def combo_statistics(rows: DataFrame, members: str, value: str, group: str, separator: str = " + ", least: int = 1) -> DataFrame:
    """(combo, n, mean, median): groups by the set of their members, with statistics of the groups' mean value."""
    combos = rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(members)), separator).alias("combo"), F.avg(value).alias("_v"))
    return combos.groupBy("combo").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.percentile("_v", F.lit(0.5)).alias("median")).where(F.col("n") >= least)


def selection_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, positive, mean): rows, positive values and mean of each group."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(value) > 0).alias("positive"), F.avg(value).alias("mean"))


def five_numbers(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Least, quartiles and largest value of each group."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return rows.groupBy(by).agg(q.alias("_q")).select(by, *[F.col("_q")[i].alias(n) for i, n in enumerate(("q0", "q25", "q50", "q75", "q100"))])


def yearly_mean(rows: DataFrame, value: str, by: Sequence[str] = (), date: str = DATE) -> DataFrame:
    return rows.groupBy(F.year(date).alias("year"), *by).agg(F.avg(value).alias(value))


def melt(rows: DataFrame, ids: Sequence[str], values: Mapping[str, str], name: str = "metric", value: str = "v") -> DataFrame:
    """Columns (name -> column) as rows."""
    return rows.select(*ids, *[F.col(c).cast("double").alias(n) for n, c in values.items()]).unpivot(list(ids), list(values), name, value)


def category_matrix(rows: DataFrame, group: str, category: str, levels: Mapping[str, str]) -> DataFrame:
    """A 0/1 column for each level (name -> value): whether the group has it."""
    return rows.groupBy(group).agg(*[F.max((F.col(category) == v).cast("int")).alias(n) for n, v in levels.items()])


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, kind, coverage, positive, zero, uniques) of numeric columns, from one aggregate over the table. Shares are of known values, coverage of rows."""
    kinds = dict(df.dtypes)
    aggs = [F.count("*").alias("_rows")]
    for c in columns:
        aggs += [F.count(c).alias(f"n_{c}"), F.count_if(F.col(c) > 0).alias(f"p_{c}"), F.count_if(F.col(c) == 0).alias(f"z_{c}"), F.count_distinct(c).alias(f"u_{c}")]
    one = df.agg(*aggs)
    n = lambda c: F.when(F.col(f"n_{c}") > 0, F.col(f"n_{c}"))
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(kinds[c]).alias("kind"), (F.col(f"n_{c}") / F.when(F.col("_rows") > 0, F.col("_rows"))).alias("coverage"), (F.col(f"p_{c}") / n(c)).alias("positive"), (F.col(f"z_{c}") / n(c)).alias("zero"), F.col(f"u_{c}").alias("uniques")) for c in columns])
    return one.select(F.inline(each))


def select_columns(profile: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), least_coverage: float = 0.5, least_uniques: int = 10, most: int | None = None) -> list[str]:
    """Names of a profile that cover and vary enough, best covered first, then by name; ``include`` come first whatever they are."""
    rows = profile.where((F.col("coverage") >= least_coverage) & (F.col("uniques") > least_uniques)).orderBy(F.desc("coverage"), "name").select("name").collect()
    known = {r.name for r in profile.select("name").collect()} if include else set()
    names = [*[c for c in include if c in known], *[r.name for r in rows if r.name not in (*exclude, *include)]]
    return names[:most]


def panel_summary(panel: DataFrame, flag: str = "tradeable") -> DataFrame:
    """First and last date, dates, contracts, cells, and cells with the flag."""
    return panel.agg(F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.count_distinct(DATE).alias("dates"), F.count_distinct(NAME).alias("contracts"), F.count("*").alias("cells"), F.count_if(F.col(flag)).alias("tradeable"))


def parse_list(cell: str | Column) -> Column:
    """A cell that holds a JSON list, a list literal with single quotes or names between commas, as an array of trimmed names; null and empty cells have none."""
    c = F.trim(F.col(cell) if isinstance(cell, str) else cell)
    strict = F.from_json(c, "array<string>")
    loose = F.from_json(F.translate(c, "'", '"'), "array<string>")
    bare = F.split(F.regexp_replace(c, r"^[\[(]|[\])]$", ""), ",")
    got = F.when(c.startswith("["), F.coalesce(F.when(F.size(strict) > 0, strict), F.when(F.size(loose) > 0, loose), bare)).otherwise(bare)
    return F.filter(F.transform(F.coalesce(got, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"^\s*['\"]|['\"]\s*$", ""))), lambda x: F.length(x) > 0)


def join_list(names: str | Column, separator: str = " + ") -> Column:
    return F.array_join(names, separator)


def unique_names(names: Sequence[str | None]) -> list[str]:
    """Names in order, trimmed, without empty ones and repeats."""
    return list(dict.fromkeys(n for x in names if x is not None and (n := str(x).strip())))


def newest(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """Of folders of written tables the one with the newest file; None if none has any."""
    best: tuple | None = None
    for path in paths:
        try:
            at = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.max("modificationTime")).first()[0]
        except AnalysisException:
            continue
        if at is not None and (best is None or at > best[0]):
            best = (at, path)
    return best[1] if best else None


def field_table(occurrences: DataFrame, metadata: DataFrame, field: str = "field") -> DataFrame:
    """How often each field stands in genes and in how many, with what metadata (field, family, kind) say of it, "unknown" where nothing."""
    f = frequency(occurrences, [field], "gene_id")
    rest = [c for c in metadata.columns if c != field]
    return f.join(metadata, field, "left").fillna("unknown", rest)


def analyse(results: DataFrame, gene_id: str, mode: str, metadata: DataFrame, path: str) -> dict[str, DataFrame]:
    """All frequency tables of a result table, written as csv under ``path``: fields, slots, kinds, combinations of mode and slot."""
    o = gene_occurrences(results, gene_id, keep=[mode])
    tables = {
        "fields": field_table(o, metadata), "levels": frequency_levels(o, {"place": ["place"], "slot": ["slot"], "transform": ["transform"], "mode_slot": [mode, "slot"]}),
        "kinds": frequency(o.join(metadata, "field", "left").fillna("unknown", ["kind"]), ["kind"], "gene_id"),
    }
    for name, t in tables.items():
        t.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    return tables


def order_results(results: DataFrame, objectives: Sequence[str], key: str) -> DataFrame:
    """Best first by the objectives in turn, missing ones last, then by key."""
    return results.orderBy(*[F.col(o).desc_nulls_last() for o in objectives], key)


def prefilter(results: DataFrame, score: str, most: int, key: str, least: float | None = None) -> DataFrame:
    """The ``most`` candidates of highest score that reach ``least``, for validation."""
    out = results if least is None else results.where(F.col(score) >= least)
    return out.orderBy(F.col(score).desc_nulls_last(), key).limit(most)
