"""A panel from source tables: universe, market value, industry, label, aligned factor tables, tradeable flag, choice of fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quillon.operators.results import column_profile, panel_summary
from quillon.plans.layers import DATE, NAME
from quillon.plans.panel import at_close
from quillon.plans.storage import written
from quillon.sources.tables import factor_table, wide_to_long

RESERVED = ("market_cap", "industry", "tradeable", "close", "label")
#: Kinds of factor tables by words in their names, and the coverage their fields need; others need ``OTHER_COVERAGE``.
KINDS = {"financial_statement": ("balance", "income", "cashflow", "financial"), "derivative": ("der_", "derivative", "valuation", "indicator", "flow", "orderbook", "price")}
COVERAGE, OTHER_COVERAGE = {"financial_statement": 0.6, "derivative": 0.8}, 0.7


@dataclass(frozen=True)
class Values:
    """One value by date and contract: a long table with it in ``column``, or a wide one with a column per contract."""

    table: DataFrame
    column: str | None = None
    layout: str = "auto"

    def read(self, name: str) -> DataFrame:
        """(Datetime, Contract, name), dates without a time at the close. A long table without a named column must have just one besides the keys."""
        return at_close(self.rows(name))

    def rows(self, name: str) -> DataFrame:
        """As read, with dates as they stand."""
        long = NAME in self.table.columns and DATE in self.table.columns
        if self.layout == "wide" or self.layout == "auto" and not long:
            return with_keys(wide_to_long(self.table, name))
        d = with_keys(self.table)
        rest = [c for c in d.columns if c not in (DATE, NAME)]
        column = self.column or (name if name in rest else rest[0] if len(rest) == 1 else None)
        if column is None:
            raise ValueError(f"which of {', '.join(rest)} is {name}?")
        return d.select(DATE, NAME, F.col(column).alias(name))


@dataclass(frozen=True)
class Factors:
    """A table of many numeric columns. ``carry``: whether values stand until the next row (as of), by default those of statements; at most ``limit`` dates."""

    table: DataFrame
    name: str
    kind: str | None = None
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    prefix: str = ""
    carry: bool | None = None
    limit: int | None = 300

    @property
    def of_kind(self) -> str:
        return self.kind or table_kind(self.name)

    @property
    def carried(self) -> bool:
        return self.of_kind == "financial_statement" if self.carry is None else self.carry

    def read(self) -> DataFrame:
        return at_close(self.rows())

    def rows(self) -> DataFrame:
        """As read, with dates as they stand."""
        return factor_table(with_keys(self.table), self.include, (*self.exclude, *RESERVED), self.prefix)


@dataclass(frozen=True)
class Choice:
    """Which fields stay: enough coverage for their kind and enough different values, or named; at most ``most``."""

    least_uniques: int = 20
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    most: int | None = None
    coverage: Mapping[str, float] = field(default_factory=lambda: dict(COVERAGE))
    other: float = OTHER_COVERAGE


@dataclass(frozen=True)
class Built:
    """The panel, its fields' profile (with table and kind), the fields that stayed, and what to say of it."""

    panel: DataFrame
    profile: DataFrame
    fields: tuple[str, ...]
    metadata: dict


def with_keys(df: DataFrame) -> DataFrame:
    """Keys typed: a timestamp and a string."""
    return df.withColumns({k: F.col(k).cast(t) for k, t in ((DATE, "timestamp"), (NAME, "string")) if k in df.columns})


def table_kind(name: str) -> str:
    low = name.lower()
    return next((k for k, words in KINDS.items() if any(w in low for w in words)), "other")


def keyword_hit(name: str, words: Sequence[str]) -> bool:
    return any(w in name.lower() for w in words)


def gathered(sources: Sequence[tuple[DataFrame, Sequence[str]]], group: DataFrame) -> DataFrame:
    """(Datetime, Contract, _source, _group, _values): rows of all sources one under another, read and written once.

    Numbers of a row are one array, so that a row is as wide as its own source only. ``group`` is source 0. Sources whose
    dates have no time of day move to the close.
    """
    kind = dict(group.dtypes)["industry"]
    rows = group.select(DATE, NAME, F.lit(0).alias("_source"), F.col("industry").alias("_group"), F.lit(None).cast("array<double>").alias("_values"))
    for i, (d, names) in enumerate(sources, 1):
        numbers = [F.col(c).cast("double") for c in names]
        finite = [F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) for x in numbers]
        rows = rows.unionByName(d.select(DATE, NAME, F.lit(i).alias("_source"), F.lit(None).cast(kind).alias("_group"), F.array(*finite).alias("_values")))
    rows = written(rows, "sources")
    daily = F.min((F.date_trunc("day", DATE) == F.col(DATE)).cast("int"))
    whole_days = [r["_source"] for r in rows.groupBy("_source").agg(daily.alias("d")).where("d = 1").collect()]  # one row per source
    return rows.withColumn(DATE, F.when(F.col("_source").isin(whole_days), F.col(DATE) + F.expr("INTERVAL 15 HOURS")).otherwise(F.col(DATE)))


def ahead(rows: DataFrame, source: int, horizon: int, into: int) -> DataFrame:
    """Rows of a source ``horizon`` of its own dates earlier, as source ``into``: what is then known of the future. Only dates pass one window."""
    own = rows.where(F.col("_source") == source)
    dates = own.select(DATE).distinct()
    earlier = dates.select(DATE, F.lag(DATE, horizon).over(Window.orderBy(DATE)).alias("_earlier")).where("_earlier IS NOT NULL")
    moved = own.join(earlier, DATE).withColumn(DATE, F.col("_earlier")).withColumn("_source", F.lit(into))
    return moved.select(*rows.columns)


def build_panel(
    industry: Values, market_cap: Values, factors: Sequence[Factors] = (), groups: Sequence[str] | None = None, close: Values | None = None, label: Values | None = None, tradeable: Values | None = None,
    horizon: int = 20, label_name: str = "label", choice: Choice = Choice(),
) -> Built:
    """The panel over the dates and contracts of the industry table whose group is wanted.

    Factor tables are aligned to those keys, statements as of their last row; of columns with one name the first table's
    stays. Without a label the return of ``close`` over ``horizon`` dates is one; without a flag, what has a market value
    is tradeable. NaN and infinite values are missing, and numbers are doubles. Of rows with one key in a table the
    largest stays.

    Every source is read once, into one written table. That is dealt out by contract once, and in this one order keys are
    brought together, values carried forward and returns taken; the panel is written, and its profile and summary read it.
    """
    if label is None and close is None:
        raise ValueError("a label or a close is needed")
    # name -> (place among the sources, place in its array)
    place: dict[str, tuple[int, int]] = {}
    sources: list[tuple[DataFrame, list[str]]] = []

    def add(d: DataFrame, names: Sequence[str]) -> list[str]:
        own = [c for c in names if c not in place]
        sources.append((d, own))
        place.update({c: (len(sources), k) for k, c in enumerate(own)})
        return own

    for v, name in ((market_cap, "market_cap"), (close, "close"), (label, label_name), (tradeable, "tradeable")):
        if v is not None:
            add(v.rows(name), [name])
    source: dict[str, tuple[str, str]] = {}
    carried: list[tuple[int, list[str], int | None]] = []
    for t in factors:
        d = t.rows()
        own = add(d, [c for c in d.columns if c not in (DATE, NAME, label_name)])
        source |= {c: (t.name, t.of_kind) for c in own}
        if t.carried:
            carried.append((len(sources), own, t.limit))
    rows = gathered(sources, industry.rows("industry"))
    future = len(sources) + 1
    if label is None:
        rows = rows.unionByName(ahead(rows, place["close"][0], horizon, future))
    at = lambda i: F.max(F.when(F.col("_source") == i, F.col("_values"))).alias(f"_{i}")
    keyed = rows.repartition(NAME).groupBy(NAME, DATE).agg(F.max("_group").alias("industry"), *[at(i) for i in range(1, future + 1)])
    wanted = F.col("industry").isNotNull() if groups is None else F.coalesce(F.col("industry").isin(list(groups)), F.lit(False))
    if groups is not None and not groups:
        raise ValueError("an empty universe")
    value = lambda c: F.col(f"_{place[c][0]}")[place[c][1]]
    w = Window.partitionBy(NAME).orderBy(DATE)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = keyed.withColumn("_wanted", wanted)
    # A limit counts dates of the wanted keys and of the table itself.
    counted = {i: F.sum((F.col("_wanted") | F.col(f"_{i}").isNotNull()).cast("int")).over(so_far) for i, _, _ in carried}
    keyed = keyed.withColumns({f"_at{i}": c for i, c in counted.items()}) if carried else keyed
    found = {c: value(c) for c in place}
    for i, own, limit in carried:
        for c in own:
            last = F.last(value(c), ignorenulls=True).over(so_far)
            seen = F.max(F.when(value(c).isNotNull(), F.col(f"_at{i}"))).over(so_far)
            found[c] = last if limit is None else F.when(F.col(f"_at{i}") - seen <= limit, last)
    if label is None:
        found[label_name] = F.when(value("close") != 0, F.col(f"_{future}")[0] / value("close") - 1)
    # Without a flag, what has a market value is tradeable.
    flag = F.coalesce(found["tradeable"] > 0, F.lit(False)) if tradeable is not None else found["market_cap"].isNotNull()
    fields = list(source)
    kept_keys = ["market_cap", "industry", "tradeable", label_name, *(["close"] if close is not None else [])]
    columns = {c: x for c, x in found.items() if c != "tradeable"} | {"tradeable": flag, "industry": F.col("industry")}
    panel = keyed.select(DATE, NAME, "_wanted", *[columns[c].alias(c) for c in dict.fromkeys([*kept_keys, *fields])]).where("_wanted").drop("_wanted")
    panel = written(panel, "panel")
    summary = panel_summary(panel).first()
    if not summary["cells"]:
        raise ValueError("an empty universe")
    profile, kept = chosen(panel, source, choice)
    panel = panel.select(DATE, NAME, *kept_keys, *kept)
    return Built(panel, profile, tuple(kept), describe(panel, kept, summary))


def chosen(panel: DataFrame, source: Mapping[str, tuple[str, str]], choice: Choice) -> tuple[DataFrame, list[str]]:
    """The fields' profile, with table and kind, and those that stay. One aggregate profiles all, and only its few rows come back."""
    spark = panel.sparkSession
    if not source:
        empty = "name string, kind string, coverage double, positive double, zero double, uniques bigint, table string, table_kind string"
        return spark.createDataFrame([], empty), []
    rows = column_profile(panel, list(source)).collect()
    kept = []
    for r in sorted(rows, key=lambda r: (-r.coverage, r.name)):
        enough = r.coverage >= choice.coverage.get(source[r.name][1], choice.other) and r.uniques >= choice.least_uniques
        if r.name not in choice.exclude and (enough or r.name in choice.include):
            kept.append(r.name)
    schema = "name string, kind string, coverage double, positive double, zero double, uniques bigint, table string, table_kind string"
    names = [c.split(" ")[0] for c in schema.split(", ")][:6]
    told = [(*[r[c] for c in names], *source[r.name]) for r in rows]
    return spark.createDataFrame(told, schema), kept[: choice.most]


def describe(panel: DataFrame, fields: Sequence[str], summary: Row | None = None) -> dict:
    """What is written next to a panel: shape, dates, contracts, fields."""
    s = summary or panel_summary(panel).first()
    return {"index": [DATE, NAME], "rows": s["cells"], "columns": len(panel.columns), "n_dates": s["dates"], "n_contracts": s["contracts"], "start": str(s["first_date"]), "end": str(s["last_date"]), "selected_fields": list(fields)}


def draft_rule(name: str, kind: str, positive: float) -> dict[str, bool]:
    """A first rule of a field from its profile: logs for what is nearly always positive and no rate, changes in per cent for what isn't one already, standardising for all but statements."""
    rate = keyword_hit(name, ("ratio", "growth", "return", "yield", "rate", "rank", "score"))
    return {"can_y": True, "can_x": True, "allow_log": positive >= 0.95 and not rate, "allow_current": True, "allow_lag": True, "allow_diff": True, "allow_pct": not rate, "allow_std": kind != "financial_statement"}
