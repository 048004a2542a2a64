"""Alignment of keyed tables: joins on (Datetime, Contract), as-of carrying, universes, dates and sessions, first and last rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.layers import DATE, NAME

KEYS = (DATE, NAME)
#: Continuous trading: inclusive times of day.
CONTINUOUS = (("09:35", "11:30"), ("13:05", "15:00"))


def inner_align(*frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows whose key every table has, with the columns of all."""
    return reduce(lambda a, b: a.join(b, list(keys), "inner"), frames)


def align_to(target: DataFrame, other: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The target's rows with the other table's columns, missing where it has no such key."""
    return target.join(other, list(keys), "left")


def outer_concat(*frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of every key that any table has, with the columns of all."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), frames)


def concat_first(*frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """As outer_concat; of columns with one name the first table's stays."""
    seen, parts = set(keys), []
    for d in frames:
        parts.append(d.select(*keys, *[c for c in d.columns if c not in seen]))
        seen |= set(d.columns)
    return outer_concat(*parts, keys=keys)


def fill_from(panel: DataFrame, flags: DataFrame, column: str, fill: float = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """The panel with a column of another table, ``fill`` where that has no value."""
    return align_to(panel, flags.select(*keys, column), keys).withColumn(column, F.coalesce(F.col(column), F.lit(fill)))


def with_attributes(rows: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Rows with attributes of what they are about (coefficients with genes, ranks with objectives)."""
    return rows.join(attributes, key, "left")


def lookup(rows: DataFrame, table: DataFrame, key: str, table_key: str, values: Mapping[str, str], default: str = "unknown") -> DataFrame:
    """Rows with named values of a lookup table (name -> its column), ``default`` where it has no such key."""
    t = table.select(F.col(table_key).alias("_key"), *[F.col(v).alias(f"_{n}") for n, v in values.items()])
    found = rows.join(t, rows[key] == t["_key"], "left")
    return found.select(*[rows[c] for c in rows.columns], *[F.coalesce(F.col(f"_{n}").cast("string"), F.lit(default)).alias(n) for n in values])


#: Items of one group that one key of a co-occurrence join has at most, about.
PART_ITEMS = 256


def cooccurrence(rows: DataFrame, group: str, item: str, part_items: int = PART_ITEMS) -> DataFrame:
    """(a, b, n): in how many groups two items stand together, either way round and with themselves.

    A group's items are dealt to parts by their hash, and each two parts meet under a key of their own, so a large group is
    many keys of bounded size. Pairs are made one way round only and counted before they are exchanged; their mirror images
    are made of the counts.
    """
    pairs = rows.select(F.col(group).alias("_g"), F.col(item).alias("_x")).where(F.col("_x").isNotNull() & F.col("_g").isNotNull()).distinct()
    parts = pairs.groupBy("_g").agg(F.ceil(F.count("*") / part_items).cast("int").alias("_parts"))
    dealt = pairs.join(parts, "_g").withColumn("_p", F.pmod(F.xxhash64("_x", F.lit(7)), F.col("_parts")).cast("int"))
    a = dealt.select("_g", F.col("_p").alias("_i"), F.explode(F.sequence("_p", F.col("_parts") - 1)).alias("_j"), F.col("_x").alias("_a"))
    b = dealt.select("_g", F.explode(F.sequence(F.lit(0), F.col("_p"))).alias("_i"), F.col("_p").alias("_j"), F.col("_x").alias("_b"))
    met = a.join(b, ["_g", "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("_a") <= F.col("_b")))
    counted = met.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.count("*").alias("n"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return counted.select(F.explode(both).alias("_p"), "n").select("_p.a", "_p.b", "n")


def as_of(reports: DataFrame, targets: DataFrame, columns: Sequence[str], limit: int | None = None, date: str = DATE, name: str = NAME) -> DataFrame:
    """Target rows (date, name) with each column's last known value at or before the date.

    A value is carried over at most ``limit`` further dates, those of reports and of targets counted together. Both sides
    are dealt out by name once and read in order of date; no pair of report and target is ever made.
    """
    both = targets.select(date, name).distinct().withColumn("_target", F.lit(True)).join(reports.select(date, name, *columns), [date, name], "full_outer")
    w = Window.partitionBy(name).orderBy(date)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_i", F.row_number().over(w))

    def carried(c: str) -> Column:
        last = F.last(c, ignorenulls=True).over(so_far)
        if limit is None:
            return last
        seen = F.max(F.when(F.col(c).isNotNull(), F.col("_i"))).over(so_far)
        return F.when(F.col("_i") - seen <= limit, last)

    return both.select(date, name, "_target", *[carried(c).alias(c) for c in columns]).where("_target").drop("_target")


def business_offset(rows: DataFrame, calendar: DataFrame, lag: int, date: str = DATE, into: str = "known") -> DataFrame:
    """Rows with the ``lag``-th date of the calendar after their own, missing beyond its end. Only dates pass one window."""
    days = calendar.select(F.col(date).alias("_d")).distinct().withColumn("_open", F.lit(1))
    marks = rows.select(F.col(date).alias("_d")).distinct().join(days, "_d", "full_outer")
    numbered = marks.withColumn("_n", F.sum(F.coalesce("_open", F.lit(0))).over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)))
    at = numbered.where("_open = 1").select(F.col("_d").alias(into), F.col("_n").alias("_m"))
    known = numbered.join(at, F.col("_n") + lag == F.col("_m"), "left").select(F.col("_d").alias(date), into)
    return rows.join(known, date, "left")


def report_to_daily(reports: DataFrame, targets: DataFrame, columns: Sequence[str], lag: int = 20, limit: int | None = None) -> DataFrame:
    """Reports by period end, known ``lag`` dates of the targets' calendar later, carried forward to the targets.

    Of reports that become known on one date, each column's value is the latest report's that has one (of equal report
    dates the largest).
    """
    known = business_offset(reports.withColumn("_report", F.col(DATE)), targets, lag).where("known IS NOT NULL")
    latest = [F.max(F.when(F.col(c).isNotNull(), F.struct("_report", c)))[c].alias(c) for c in columns]
    return as_of(known.groupBy(F.col("known").alias(DATE), NAME).agg(*latest), targets, columns, limit)


def take_dates(df: DataFrame, dates: DataFrame, date: str = DATE) -> DataFrame:
    """The rows of some dates. A date that the table doesn't have is an error."""
    wanted = dates.select(date).distinct()
    unknown = wanted.join(df.select(date).distinct(), date, "left_anti").limit(5).collect()
    if unknown:
        raise KeyError(f"unknown dates: {', '.join(str(r[0]) for r in unknown)}")
    return df.join(wanted, date, "left_semi")


def sessions(df: DataFrame, ranges: Sequence[tuple[str, str]] = CONTINUOUS, at: str = DATE) -> DataFrame:
    """Rows whose time of day, to the minute, is in one of the inclusive ranges."""
    t = F.date_format(at, "HH:mm")
    return df.where(reduce(lambda a, b: a | b, [t.between(lo, hi) for lo, hi in ranges]))


def universe(df: DataFrame, contracts: Sequence[str] | None = None, groups: Sequence[str] | None = None, group: str = "industry") -> DataFrame:
    """Rows of the given contracts and groups; an empty choice is an error."""
    for chosen in (contracts, groups):
        if chosen is not None and not chosen:
            raise ValueError("an empty universe")
    out = df if contracts is None else df.where(F.col(NAME).isin(list(contracts)))
    return out if groups is None else out.where(F.col(group).isin(list(groups)))


def narrow(df: DataFrame) -> DataFrame:
    """Doubles as floats, for the sink only."""
    return df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key in the given order."""
    return keep_first(df, keys, [(F.col(c) if isinstance(c, str) else c).desc() for c in order])


def union_first(*frames: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """Tables one after another; of rows with one key the earliest table's stays, by ``order`` within it."""
    parts = [d.withColumn("_source", F.lit(i)) for i, d in enumerate(frames)]
    return keep_first(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), keys, ["_source", *order])


def top(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, groups: Sequence[str], n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows of each group in the given order."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both tables have."""
    return a.intersect(b)


def absent(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the first table that the second lacks."""
    return a.subtract(b)


def sort_panel(df: DataFrame) -> DataFrame:
    """The panel in order of its keys, for the eye; no operator needs it."""
    return df.orderBy(*KEYS)
