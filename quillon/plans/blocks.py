"""Panels of which a contract may have more rows than one task should hold.

Windows over a contract's rows put all of them into one task. A blocked panel is dealt out by ranges of (contract, date)
instead, about as many rows each, so that a long contract is several blocks. What a window needs from beyond its block, the
rows just before and after it, is copied to it; values carried forward without a limit come from the blocks before as one
row a block. Results are those of the same functions over whole contracts.

Only columns are added to a panel, so any function of the library works on a blocked one as it is.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.ranking import ranked
from quillon.functions.sliding import slide
from quillon.plans.layers import DATE, NAME, Layers, SparkPanel
from quillon.plans.storage import written

BLOCK, AT, OWN = "_block", "_at", "_own"

#: Rows of a block where nothing else is said.
SMALLEST, LARGEST = 1_000, 1_000_000

#: A contract's rows by date, within a block.
IN_BLOCK = f"PARTITION BY {NAME}, {BLOCK} ORDER BY {DATE}"

_NUMBER = f"row_number() OVER ({Layers.T})"
_RUNNING = f"OVER ({Layers.T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_CARRIED = re.compile(r"(last_value|max|min|sum|count)\((.*)\)( IGNORE NULLS)? " + re.escape(_RUNNING))


@dataclass
class Step:
    """Layers that run on the same rows: ``whole`` ones on each row once, others on blocks with ``back`` and ``ahead`` rows from beyond."""

    whole: bool
    layers: list[list[str]] = field(default_factory=list)
    back: int = 0
    ahead: int = 0


def reach(expression: str) -> tuple[int, int]:
    """How many rows before and after its own a time-series expression reads. One without a bound is an error."""
    rest, back, ahead = expression, [0], [0]
    for pattern, found in (
        (rf"OVER \({Layers.T} ROWS BETWEEN (\d+) PRECEDING AND CURRENT ROW\)", back),
        (rf"\blag\(\w+, (\d+)\) OVER \({Layers.T}\)", back),
        (rf"\blead\(\w+, (\d+)\) OVER \({Layers.T}\)", ahead),
    ):
        found += [int(n) for n in re.findall(pattern, rest)]
        rest = re.sub(pattern, "", rest)
    if Layers.T in rest:
        raise ValueError(f"no bound to the rows this needs: {expression}")
    return max(back), max(ahead)


class BlockedPanel(SparkPanel):
    """Layers over a table that is cut into blocks of about ``rows_per_block`` rows; left out, about two blocks a core, of 1,000 to 1,000,000 rows.

    Keys are never null (``validate_panel``). The table is counted, dealt out by range and written to the shared folder once,
    so that a block means the same rows in every job and after the loss of an executor; besides it one row a contract and
    block is kept. Dates must be known to the microsecond only as far as they differ: rows of one contract and date stay in
    one block, in any order.
    """

    def __init__(self, df: DataFrame, decimals: int | None = None, rows_per_block: int | None = None):
        if rows_per_block is not None and rows_per_block < 1:
            raise ValueError("a block has at least one row")
        rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
        if rows_per_block is None:
            rows_per_block = min(LARGEST, max(SMALLEST, -(-rows // (2 * cores))))
        n = max(1, -(-rows // rows_per_block))
        # The number of a sorted range and the place in it are the two halves of the id.
        dealt = df.repartitionByRange(n, NAME, DATE).sortWithinPartitions(NAME, DATE).withColumn("_id", F.monotonically_increasing_id())
        dealt = written(dealt, "blocks").withColumn(BLOCK, F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
        before = Window.partitionBy(NAME).orderBy(BLOCK)
        held = dealt.groupBy(NAME, BLOCK).agg(F.count("*").alias("n"), F.min("_place").alias("begin"))
        held = held.withColumn("last", F.sum("n").over(before)).withColumn("blocks", F.count("*").over(Window.partitionBy(NAME)))
        self.bounds = written(held.select(NAME, BLOCK, "begin", (F.col("last") - F.col("n") + 1).alias("first"), "last", "blocks"), "bounds")
        base = dealt.join(self.bounds, [NAME, BLOCK]).withColumn(AT, F.col("_place") - F.col("begin") + F.col("first"))
        super().__init__(base.select(*df.columns, BLOCK, AT), decimals)

    def anew(self) -> BlockedPanel:
        other = copy.copy(self)
        SparkPanel.__init__(other, self.base, self.decimals)
        return other

    @property
    def cut(self) -> DataFrame:
        """Bounds of contracts of several blocks: at most two for every range of rows, however many contracts there are."""
        return self.bounds.where("blocks > 1")

    def steps(self, wanted: Sequence[str] | None = None) -> list[Step]:
        """Layers in the order they run in, those that need the same rows together."""
        out = [Step(False)]
        for layer in self.layers(wanted):
            whole = [k for k in layer if self._is_whole(k)]
            if whole:
                out += [Step(True, [whole]), Step(False)]
            rest = [k for k in layer if k not in whole]
            if rest:
                own = [(self.slides[k].w - 1, 0) if k in self.slides else reach(self._numbered(self.sql[k])) for k in rest]
                out[-1].layers.append(rest)
                out[-1].back += max(b for b, _ in own)
                out[-1].ahead += max(a for _, a in own)
        return [s for s in out if s.layers]

    def _numbered(self, expression: str) -> str:
        return expression.replace(_NUMBER, AT)

    def _is_whole(self, name: str) -> bool:
        """Whether an expression needs every row once: over a date's rows, or over all rows of a contract so far."""
        if name in self.slides or name in self.ranks:
            return name in self.ranks
        other = self._numbered(self.sql[name]).replace(Layers.T, "")
        if "PARTITION BY" in other and Layers.T in self._numbered(self.sql[name]):
            raise ValueError(f"windows over contracts and over dates need columns of their own: {self.sql[name]}")
        return "PARTITION BY" in other or "OVER ()" in other or bool(_CARRIED.fullmatch(self.sql[name]))

    def frame(self, wanted: Sequence[str] | None = None, keep: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
        """The panel with all its own and the wanted columns; each row once, as from a panel of whole contracts; of these the rows ``where`` keeps."""
        df = self.base
        for s in self.steps(wanted):
            if s.whole:
                carried = {k: m for k in s.layers[0] if (m := _CARRIED.fullmatch(self.sql[k]))}
                plain = [k for k in s.layers[0] if k not in carried and k not in self.ranks]
                ranks = {k: self.ranks[k] for k in s.layers[0] if k in self.ranks}
                df = self._carry(df, carried) if carried else df
                df = df.select("*", *[F.expr(self.sql[k]).alias(k) for k in plain]) if plain else df
                df = ranked(df.repartition(DATE).sortWithinPartitions(DATE), ranks, DATE, df.columns) if ranks else df
                continue
            copied = s.back or s.ahead
            df = self._with_neighbours(df, s.back, s.ahead) if copied else df
            for layer in s.layers:
                plain, walked = [k for k in layer if k not in self.slides], {k: self.slides[k] for k in layer if k in self.slides}
                if plain:
                    df = df.select("*", *[F.expr(self._numbered(self.sql[k]).replace(Layers.T, IN_BLOCK)).alias(k) for k in plain])
                if walked:
                    df = slide(df, walked, IN_BLOCK)
            df = df.where(OWN).drop(OWN) if copied else df
        df = df.drop(BLOCK, AT)
        return df.where(where) if where else df

    def _with_neighbours(self, df: DataFrame, back: int, ahead: int) -> DataFrame:
        """Rows with copies for every block that starts at most ``back`` rows after them, or ended at most ``ahead`` rows before."""
        order = Window.partitionBy(NAME).orderBy("first")
        ends = self.cut.select(NAME, BLOCK, "first", "last", F.lead(BLOCK).over(order).alias("next"), F.lag(BLOCK).over(order).alias("previous"))
        # The block after one that ends at e starts at e + 1, the one before one that starts at s ends at s - 1.
        later = F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("b"), (F.col("last") + 1).alias("edge")))
        earlier = F.when(F.col("previous").isNotNull(), F.struct(F.col("previous").alias("b"), (F.col("first") - 1).alias("edge")))
        none = F.expr("CAST(array() AS ARRAY<STRUCT<b: BIGINT, edge: BIGINT>>)")
        near = ends.select(
            NAME, BLOCK,
            (F.collect_list(later).over(Window.partitionBy(NAME).orderBy("last").rangeBetween(0, back - 1)) if back else none).alias("_later"),
            (F.collect_list(earlier).over(Window.partitionBy(NAME).orderBy("first").rangeBetween(1 - ahead, 0)) if ahead else none).alias("_earlier"),
        )
        to = f"""concat(array(named_struct('b', {BLOCK}, 'own', true)),
          transform(filter(coalesce(_later, CAST(array() AS ARRAY<STRUCT<b: BIGINT, edge: BIGINT>>)), e -> {AT} >= e.edge - {back}), e -> named_struct('b', e.b, 'own', false)),
          transform(filter(coalesce(_earlier, CAST(array() AS ARRAY<STRUCT<b: BIGINT, edge: BIGINT>>)), e -> {AT} <= e.edge + {ahead}), e -> named_struct('b', e.b, 'own', false)))"""
        kept = [c for c in df.columns if c != BLOCK]
        dealt = df.join(near, [NAME, BLOCK], "left").select(*kept, F.explode(F.expr(to)).alias("_to"))
        return dealt.select(*kept, F.col("_to.b").alias(BLOCK), F.col("_to.own").alias(OWN))

    def _carry(self, df: DataFrame, columns: dict[str, re.Match]) -> DataFrame:
        """Running values: those within the block, and what the blocks before come to, one row for each."""
        cut = df.join(self.cut.select(NAME, BLOCK), [NAME, BLOCK], "left_semi")
        whole, before = [], []
        for k, m in columns.items():
            f, x = m[1], m[2]
            ends = f"max_by({x}, {AT}) FILTER (WHERE ({x}) IS NOT NULL)" if f == "last_value" else f"{f}({x})"
            whole.append(F.expr(ends).alias(k))
            joined = {"last_value": "last_value({0}) IGNORE NULLS", "count": "sum({0})"}.get(f, f + "({0})").format(k)
            before.append(F.expr(f"{joined} OVER (PARTITION BY {NAME} ORDER BY {BLOCK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias(f"_{k}"))
        brought = cut.groupBy(NAME, BLOCK).agg(*whole).select(NAME, BLOCK, *before)
        running = df.select("*", *[F.expr(self.sql[k].replace(Layers.T, IN_BLOCK)).alias(k) for k in columns])
        out = running.join(brought, [NAME, BLOCK], "left")
        return out.select(*df.columns, *[_joined(m[1], F.col(k), F.col(f"_{k}")).alias(k) for k, m in columns.items()])


def _joined(f: str, own: Column, before: Column) -> Column:
    """A running value within the block and the one of the blocks before, as one."""
    if f == "last_value":
        return F.coalesce(own, before)
    if f in ("max", "min"):
        return (F.greatest if f == "max" else F.least)(own, before)
    return F.when(own.isNull(), before).when(before.isNull(), own).otherwise(own + before)
