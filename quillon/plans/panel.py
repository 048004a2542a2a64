"""Panels: preparation of any long table, and a weekly panel of suppliers built from order lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.layers import DATE, NAME, SparkPanel, SqlText


@dataclass(frozen=True)
class PanelContext:
    """Names of a panel's roles, and how its candidate fields are chosen."""

    tradeable: str = "tradeable"
    industry: str = "industry"
    label: str = "label"
    styles: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_prefixes: tuple[str, ...] = field(default=("label_",))

    def column(self, df: DataFrame, role: str) -> Column:
        """The column of a role (label, tradeable, industry, or a style by name); one that isn't there is an error."""
        name = {"label": self.label, "tradeable": self.tradeable, "industry": self.industry}.get(role, role)
        if name not in df.columns or role not in ("label", "tradeable", "industry") and name not in self.styles:
            raise KeyError(f"no {role!r} in this panel")
        return F.col(name)

    def matrix(self, df: DataFrame, column: str, most: int = 1_000_000):
        """One column as a pandas table of dates by contracts, for a look at a small panel; more cells than ``most`` are an error."""
        d = df.select(DATE, NAME, column)
        if d.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} cells")
        return d.toPandas().pivot(index=DATE, columns=NAME, values=column)

    def fields(self, df: DataFrame) -> list[str]:
        """Numeric columns that may be searched, in order, without keys, roles and excluded names."""
        out = {DATE, NAME, "_block", "_at", self.tradeable, self.industry, self.label, *self.exclude}
        kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
        return [c for c, t in df.dtypes if t in kinds and c not in out and not c.startswith(self.exclude_prefixes)]


#: Columns of a wide table in blocks (``tables.long_to_wide``).
BLOCK, NAMES, VALUES = "_block", "_names", "_values"


def in_blocks(df: DataFrame) -> bool:
    """Whether a wide table is rows of blocks: arrays of contracts' names and values by date and block."""
    return {BLOCK, NAMES, VALUES} <= set(df.columns)


class PanelError(ValueError):
    """A table that isn't a valid panel."""


def validate_panel(df: DataFrame, strict: bool = True) -> bool:
    """Keys must be there, typed, never null and unique, and times of day must not all be midnight. Raises if ``strict``."""

    def fail(why: str) -> bool:
        if strict:
            raise PanelError(why)
        return False

    types = dict(df.dtypes)
    if not types.get(DATE, "").startswith("timestamp") or NAME not in types:
        return fail(f"a panel has a timestamp {DATE} and a {NAME}")
    null = F.max((F.col(DATE).isNull() | F.col(NAME).isNull()).cast("int"))
    timed = F.max((F.date_trunc("day", DATE) != F.col(DATE)).cast("int"))
    r = df.agg(null.alias("null"), timed.alias("timed")).first()
    if r["null"]:
        return fail("keys must not be null")
    if r["timed"] == 0:
        return fail("times need a time of day")
    if not df.groupBy(DATE, NAME).count().where("count > 1").isEmpty():
        return fail("keys must be unique")
    return True


def validate_wide(df: DataFrame, strict: bool = True) -> bool:
    """A wide table: one timestamp Datetime, never null and unique, times of day not all midnight, every other column a number; or one in blocks (``tables.long_to_wide``). Raises if ``strict``."""

    def fail(why: str) -> bool:
        if strict:
            raise PanelError(why)
        return False

    kinds = dict(df.dtypes)
    if not kinds.get(DATE, "").startswith("timestamp"):
        return fail(f"a wide table has a timestamp {DATE}")
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    if in_blocks(df):
        return _validate_blocks(df, kinds[VALUES], numbers, fail)
    odd = [c for c, t in kinds.items() if c != DATE and t not in numbers]
    if odd or len(kinds) < 2:
        return fail(f"columns that are no numbers: {odd}" if odd else "no contracts")
    r = df.agg(F.count("*").alias("n"), F.count_distinct(DATE).alias("d"), F.max((F.date_trunc("day", DATE) != F.col(DATE)).cast("int")).alias("timed")).first()
    if r["n"] != r["d"]:
        return fail("dates must be there and unique")
    return fail("times need a time of day") if r["timed"] == 0 else True


def _validate_blocks(df: DataFrame, kind: str, numbers: tuple[str, ...], fail: Callable[[str], bool]) -> bool:
    """A wide table in blocks: dates as in any wide table, every date has every block, and a block's contracts are the same on all dates, each once."""
    if kind not in {f"array<{t}>" for t in numbers}:
        return fail(f"values that are no numbers: {kind}")
    names = F.sha2(F.to_json(NAMES), 256)
    uneven = F.coalesce(F.size(NAMES) != F.size(VALUES), F.lit(True)) | (F.size(F.array_distinct(NAMES)) != F.size(NAMES))
    by = df.groupBy(BLOCK).agg(
        F.count("*").alias("n"), F.count_distinct(DATE).alias("d"), F.count_distinct(names).alias("kinds"), F.max(uneven.cast("int")).alias("uneven"), F.max((F.date_trunc("day", DATE) != F.col(DATE)).cast("int")).alias("timed"),
    )
    r = by.agg(F.max((F.col("n") != F.col("d")).cast("int")).alias("twice"), F.max("uneven").alias("uneven"), F.max("kinds").alias("kinds"), F.max("timed").alias("timed"), F.min("d").alias("least"), F.max("d").alias("most")).first()
    if r["twice"]:
        return fail("dates must be there and unique")
    if r["uneven"] or (r["kinds"] or 0) > 1 or r["least"] != r["most"]:
        return fail("blocks must have the same contracts on every date, each once")
    if df.select(F.explode(NAMES).alias("name"), BLOCK).distinct().groupBy("name").count().where("count > 1").limit(1).count():
        return fail("a contract must be in one block")
    return fail("times need a time of day") if r["timed"] == 0 else True


def storage(df: DataFrame) -> dict[str, object]:
    """What a table takes: whether and where it is kept, its partitions, and the size the optimiser expects in bytes."""
    level = df.storageLevel
    expected = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return {"memory": level.useMemory, "disk": level.useDisk, "partitions": df.rdd.getNumPartitions(), "expected_bytes": int(str(expected))}


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinite values as null, in every floating column."""
    return df.select(*[F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes])


def at_close(df: DataFrame, hour: int = 15) -> DataFrame:
    """Dates without any time of day move to the close."""
    midnight = df.agg(F.min((F.date_trunc("day", DATE) == F.col(DATE)).cast("int"))).first()[0]
    return df.withColumn(DATE, F.col(DATE) + F.expr(f"INTERVAL {hour} HOURS")) if midnight else df


def densify(df: DataFrame) -> DataFrame:
    """One row for every date and contract that occur; absent cells are null. Dates, the short side, are broadcast as one array row per contract."""
    dates = df.groupBy().agg(F.sort_array(F.collect_set(DATE)).alias("dates"))
    grid = df.select(NAME).distinct().crossJoin(F.broadcast(dates)).select(NAME, F.explode("dates").alias(DATE))
    return grid.join(df, [DATE, NAME], "left")


def prepare(df: DataFrame, context: PanelContext, blocked: bool = False, rows_per_block: int | None = None) -> SparkPanel:
    """A checked, cleaned, dense panel whose tradeable column is a boolean; ``blocked`` cuts long contracts into blocks."""
    validate_panel(df)
    d = densify(clean(df))
    if context.tradeable in d.columns:
        d = d.withColumn(context.tradeable, F.coalesce(F.col(context.tradeable).cast("double") > 0, F.lit(False)))
    if blocked:
        from quillon.plans.blocks import BlockedPanel

        return BlockedPanel(d, rows_per_block=rows_per_block)
    return SparkPanel(d)


#: Fields of the weekly panel.
FIELDS = ("price", "high", "low", "volume", "amount", "discount", "tax")
COLUMNS = (DATE, NAME, "industry", "tradeable", *FIELDS, "lines", "label", "size")

_WEEKS = f"""
weeks AS (
  SELECT date_trunc('week', l_shipdate) AS {DATE}, l_suppkey AS {NAME}, round(sum(l_extendedprice) / sum(l_quantity) + 1.3E-6, 3) AS price0,
         max(round(l_extendedprice / l_quantity + 1.3E-6, 3)) AS high0, min(round(l_extendedprice / l_quantity + 1.3E-6, 3)) AS low0,
         sum(l_quantity) AS volume0, round(sum(l_extendedprice), 2) AS amount0, round(avg(l_discount) + 1.3E-8, 5) AS discount0,
         round(avg(l_tax) + 1.3E-8, 5) AS tax0, count(*) AS lines
  FROM lineitem GROUP BY date_trunc('week', l_shipdate), l_suppkey),
grid AS (SELECT d.{DATE}, c.{NAME} FROM (SELECT DISTINCT {DATE} FROM weeks) d CROSS JOIN (SELECT DISTINCT {NAME} FROM weeks) c),
cells AS (
  SELECT g.{DATE}, g.{NAME}, 'r' || CAST(n.n_regionkey AS VARCHAR(9)) AS industry, w.lines IS NOT NULL AS tradeable,
         w.price0, w.high0, w.low0, w.volume0, w.amount0, w.discount0, w.tax0, w.lines
  FROM grid g LEFT JOIN weeks w ON g.{DATE} = w.{DATE} AND g.{NAME} = w.{NAME}
  LEFT JOIN supplier s ON g.{NAME} = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey)"""


# Values are rounded just off the middle between two steps, where engines round differently.
def _base(last_known) -> str:
    over = f"PARTITION BY {NAME} ORDER BY {DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    filled = ", ".join(f"{last_known(f + '0', over)} AS {f}" for f in FIELDS)
    return f"""{_WEEKS},
filled AS (SELECT {DATE}, {NAME}, industry, tradeable, {filled}, lines FROM cells),
panel AS (
  SELECT *, round(lead(price, 4) OVER (PARTITION BY {NAME} ORDER BY {DATE}) / price - 1 + 1.3E-8, 5) AS label, round(ln(1 + amount) + 1.3E-8, 5) AS size
  FROM filled)"""


#: Bytes of order lines for each task that dates are dealt to, and most such tasks.
PART_BYTES, MOST_PARTS = 2 << 20, 1000
#: Values of panels whose queries are held against a second engine are ordered to so many decimals.
SHARED_DECIMALS = 9


def weekly_panel(spark: SparkSession, sf_dir: str) -> SparkPanel:
    """Suppliers by week: prices per unit, volume, amount, discount and tax, carried forward over weeks without lines; tradeable marks weeks with lines; label is the return over the next four weeks.

    Order lines are read and summed once. They are dealt out by supplier before they are summed, so that this is the only
    exchange of the panel. A supplier's weeks become one array, to which the calendar's other weeks are added (the calendar is a
    subquery over one column), so that the dense grid needs no join and lies by contract, as the windows that follow want it.
    """
    from quillon.plans.layers import SparkFunctions

    for t in ("lineitem", "supplier", "nation"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    cells = [f"{f}0" for f in FIELDS]
    empty = ", ".join(f"'{c}', CAST(NULL AS DOUBLE)" for c in cells)
    weeks = _WEEKS[: _WEEKS.index("grid AS")].strip().rstrip(",").replace("FROM lineitem", "FROM dealt")
    other = f"transform(array_except(calendar, transform(known, k -> k.{DATE})), d -> named_struct('{DATE}', d, {empty}, 'lines', CAST(NULL AS BIGINT)))"
    over = f"PARTITION BY {NAME} ORDER BY {DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    filled = ", ".join(f"{SparkFunctions.last_known(None, c, over)} AS {f}" for f, c in zip(FIELDS, cells, strict=True))
    sql = f"""WITH dealt AS (SELECT l_suppkey, date_trunc('week', l_shipdate) AS l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem DISTRIBUTE BY l_suppkey),
      {weeks},
      held AS (SELECT {NAME}, collect_list(named_struct('{DATE}', {DATE}, {", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cells)}, 'lines', lines)) AS known FROM weeks GROUP BY {NAME}),
      dense AS (SELECT {NAME}, inline(concat(known, {other})) FROM (SELECT *, (SELECT collect_set(date_trunc('week', l_shipdate)) FROM lineitem) AS calendar FROM held) h),
      cells AS (SELECT w.{DATE}, w.{NAME}, 'r' || CAST(n.n_regionkey AS VARCHAR(9)) AS industry, w.lines IS NOT NULL AS tradeable, {", ".join(f"w.{c}" for c in cells)}, w.lines
        FROM dense w LEFT JOIN supplier s ON w.{NAME} = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
      filled AS (SELECT {DATE}, {NAME}, industry, tradeable, {filled}, lines FROM cells)
      SELECT {", ".join(COLUMNS)} FROM (SELECT *, round(lead(price, 4) OVER (PARTITION BY {NAME} ORDER BY {DATE}) / price - 1 + 1.3E-8, 5) AS label, round(ln(1 + amount) + 1.3E-8, 5) AS size FROM filled) panel"""
    read = int(str(spark.table("lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return SparkPanel(spark.sql(sql), SHARED_DECIMALS, max(usual, min(MOST_PARTS, read // PART_BYTES)) if read > usual * PART_BYTES else None)


def weekly_text() -> SqlText:
    """The same panel as SQL text for the second engine."""
    from quillon.plans.layers import DuckFunctions

    return SqlText(_base(lambda x, o: DuckFunctions.last_known(None, x, o)), "panel", COLUMNS, SHARED_DECIMALS)
