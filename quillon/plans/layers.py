"""Layered plans over a panel.

A panel is a long table keyed by (Datetime, Contract) on a dense grid. Operators add columns to it as SQL expressions. A
column that uses another column's window result must stand in a later SELECT, so every expression gets a depth, and all
expressions of one depth make one projection: windows of one specification share one exchange, and equal expressions are
one column, whichever operator asks for them.

``SparkPanel`` turns the layers into a DataFrame; ``SqlText`` writes the same layers as one ANSI query with the functions
of a second engine, for cross-checking results.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import ranking
from quillon.functions.ranking import Rank
from quillon.functions.sliding import Slide, slide

DATE, NAME = "Datetime", "Contract"


class Layers:
    """Expressions by depth. Subclasses fix the SQL functions in which engines differ."""

    def __init__(self, columns: Sequence[str], decimals: int | None = None):
        """``decimals``: values are ordered as rounded to so many decimals. Left out, they are ordered as they are; a panel
        whose results are held against another engine's sets it, since sums in another order differ in their last bits."""
        self.depth: dict[str, int] = {c: 0 for c in columns}
        self.sql: dict[str, str] = {}
        self.slides: dict[str, Slide] = {}
        self.ranks: dict[str, Rank] = {}
        self.decimals = decimals

    # Windows, as text.
    P = f"PARTITION BY {DATE}"
    T = f"PARTITION BY {NAME} ORDER BY {DATE}"

    @staticmethod
    def trailing(w: int) -> str:
        return f"{Layers.T} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW"

    def let(self, expression: str, name: str | None = None) -> str:
        """Add a column and return its name. The same expression is added once."""
        key = name or "c" + hashlib.md5(expression.encode()).hexdigest()[:12]
        if key in self.sql:
            if self.sql[key] != expression:
                raise ValueError(f"column {key} already means something else")
            return key
        used = {w for w in re.findall(r"\w+", expression) if w in self.depth}
        self.depth[key] = 1 + max((self.depth[w] for w in used), default=0)
        self.sql[key] = expression
        return key

    def let_slide(self, kind: str, inputs: Sequence[str], w: int, n: int = 0) -> str:
        """Add a column that a walk over each contract's rows computes, and return its name."""
        inputs = tuple(self.let(f"CAST({x} AS DOUBLE)") for x in inputs)
        name = self.let(f"{kind}_{w}_{n} OF {' AND '.join(inputs)}")  # not SQL: it only names the column and what it uses
        self.slides[name] = Slide(kind, inputs, w, n)
        return name

    def let_rank(self, rank: Rank) -> str:
        """Add a column of ranks within dates, and return its name."""
        name = self.let(f"rank_{rank.place or int(rank.share)}_ OF {rank.value} AND {rank.known}" + (f" BY {rank.by}" if rank.by else ""))  # not SQL: it only names the column and what it uses
        self.ranks[name] = rank
        return name

    def ordering(self, x: str) -> str:
        """What ``x`` is ordered by."""
        return x if self.decimals is None else f"round({x}, {self.decimals})"

    def layers(self, wanted: Sequence[str] | None = None) -> list[list[str]]:
        """Names by depth, only those that ``wanted`` columns need."""
        need = set(self.sql if wanted is None else wanted)
        queue = list(need)
        while queue:
            for w in re.findall(r"\w+", self.sql.get(queue.pop(), "")):
                if w in self.sql and w not in need:
                    need.add(w)
                    queue.append(w)
        out: dict[int, list[str]] = {}
        for k in self.sql:
            if k in need:
                out.setdefault(self.depth[k], []).append(k)
        return [out[d] for d in sorted(out)]

    # Functions in which engines differ.
    def percentile(self, x: str, q: float, over: str) -> str:
        raise NotImplementedError

    def sliding_median(self, x: str, w: int) -> str:
        raise NotImplementedError

    def last_known(self, x: str, over: str) -> str:
        raise NotImplementedError

    def selected_means(self, x: str, y: str, w: int, n: int) -> str:
        raise NotImplementedError

    def ranked(self, v: str, ok: str, part: str, by: str | None) -> str:
        """The average rank of ``v`` in ``part`` (a date, and ``by``) among rows whose ``ok`` is 1."""
        raise NotImplementedError

    def rank_share(self, r: str, part: str) -> str:
        """The rank ``r`` in ``part`` over the number of ranks there."""
        raise NotImplementedError

    def placed(self, v: str, ok: str, down: bool = False) -> str:
        """The place from 1 on a date by rising (``down``: falling) ``v``, ties by contract, of rows whose ``ok`` is 1. That of other rows isn't defined."""
        raise NotImplementedError


def rounded(column: str, keys: Sequence[str] = (DATE, NAME)) -> str:
    """Results are rounded to six decimals (and -0 is 0), a little off the middle between two steps, so that engines which sum in another order agree."""
    return column if column in keys else f"round(CAST({column} AS DOUBLE) + 1.3E-10, 6) + 0.0E0"


class SparkFunctions:
    def quantile_of(self, x: str, q: float) -> str:
        """An aggregate: the quantile, linear between values."""
        return f"percentile({x}, {q})"

    def percentile(self, x: str, q: float, over: str) -> str:
        return f"percentile({x}, {q}) OVER ({over})"

    def sliding_median(self, x: str, w: int) -> str:
        return self.let_slide("median", [x], w)

    def last_known(self, x: str, over: str) -> str:
        return f"last_value({x}) IGNORE NULLS OVER ({over})"

    def selected_means(self, x: str, y: str, w: int, n: int) -> str:
        return self.let_slide("selected", [x, self.let(self.ordering(y))], w, n)

    def ranked(self, v: str, ok: str, part: str, by: str | None) -> str:
        return self.let_rank(Rank(v, ok, by))

    def rank_share(self, r: str, part: str) -> str:
        return self.let_rank(replace(self.ranks[r], share=True))

    def placed(self, v: str, ok: str, down: bool = False) -> str:
        return self.let_rank(Rank(v if v in self.depth else self.let(v), ok, place="down" if down else "up", ties=NAME))


class DuckFunctions:
    def quantile_of(self, x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    def percentile(self, x: str, q: float, over: str) -> str:
        return f"quantile_cont({x}, {q}) OVER ({over})"

    def sliding_median(self, x: str, w: int) -> str:
        over = Layers.trailing(w)
        m, n = self.let(f"quantile_cont({x}, 0.5) OVER ({over})"), self.let(f"count({x}) OVER ({over})")
        return self.let(f"CASE WHEN {x} IS NOT NULL AND {n} >= {w} THEN {m} END")

    def last_known(self, x: str, over: str) -> str:
        return f"last_value({x} IGNORE NULLS) OVER ({over})"

    def selected_means(self, x: str, y: str, w: int, n: int) -> str:
        ok = f"{x} IS NOT NULL AND {y} IS NOT NULL"
        rows = self.let(f"list_sort(list({{'y': {self.ordering(y)}, 't': {DATE}, 'x': {x}}}) FILTER (WHERE {ok}) OVER ({Layers.trailing(w)}))")
        mean = "list_sum(list_transform({}, lambda r: r.x)) / " + str(n)
        return f"CASE WHEN len({rows}) >= {w} THEN {mean.format(f'{rows}[-{n}:]')} - {mean.format(f'{rows}[:{n}]')} END"

    def ranked(self, v: str, ok: str, part: str, by: str | None) -> str:
        low = self.let(f"rank() OVER ({part} ORDER BY {ok} DESC, {v})")
        others = f"({self.let(f'count(*) OVER ({part}, {ok}, {v})')} - 1)"
        return self.let(f"CASE WHEN {ok} = 1 THEN {low} + {others} / 2.0E0 END")

    def rank_share(self, r: str, part: str) -> str:
        n = self.let(f"count({r}) OVER ({part})")
        return self.let(f"{r} / {n}")

    def placed(self, v: str, ok: str, down: bool = False) -> str:
        return self.let(f"row_number() OVER (PARTITION BY {DATE} ORDER BY {ok} DESC, {v}{' DESC' if down else ''}, {NAME})")


class SparkPanel(SparkFunctions, Layers):
    """Layers over a DataFrame."""

    dialect = "spark"

    def __init__(self, df: DataFrame, decimals: int | None = None, parts: int | None = None):
        """``parts``: how many tasks dates are dealt to at least, so that a task of a large panel holds few dates."""
        super().__init__(df.columns, decimals)
        self.base, self.parts = df, parts

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    def named(self, texts: Sequence[str]) -> list[str]:
        """Which of the panel's own columns stand in expressions."""
        found = {w for t in texts for w in re.findall(r"\w+", t)}
        return [c for c in self.base.columns if c in found]

    def anew(self) -> SparkPanel:
        """The same table without the columns added to it."""
        return SparkPanel(self.base, self.decimals, self.parts)

    def _kind(self, k: str) -> str:
        """What a column's rows must come together by: its ``date``, its ``contract``, or nothing (``plain``)."""
        if k in self.ranks or k not in self.slides and self.P in self.sql[k]:
            return "date"
        return "contract" if k in self.slides or re.search(r"\bOVER\b", self.sql[k]) else "plain"

    def _on_dates(self, where: str | None) -> bool:
        """Whether a condition asks for dates alone, so that it keeps or leaves out whole ones."""
        return bool(where) and self.named([where]) == [DATE]

    def frame(self, wanted: Sequence[str] | None = None, keep: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
        """The panel with the wanted columns; ``keep``: which of its own columns are needed besides keys (all, if left out); ``where``: which rows of the result.

        Columns over contracts and over dates are computed in turns, in each all that can be, so that rows are exchanged as
        rarely as they may. Rows that lie by date stay so while ranks and columns of the row are added; only a window over
        dates that uses ranks needs another exchange, as the engine doesn't know how rows lie after a walk. A column of the
        row itself is computed where it is used: one of the panel's own columns is never carried through an exchange, as what
        it is made of is there after it, and of others only as few go as the rest can be made of again. Dates that
        aren't wanted are left out before the exchange that follows the last column over contracts.
        """
        names = [k for layer in self.layers(wanted) for k in layer]
        own = [c for c in self.base.columns if keep is None or c in (DATE, NAME, *keep, *(wanted or ()))]
        uses = {k: list(dict.fromkeys(w for w in re.findall(r"\w+", self.sql[k]) if w in self.depth and w != k)) for k in names}
        kind = {k: self._kind(k) for k in names}
        base, asked = set(self.base.columns), self.named([where or ""])
        free = set()  # of the row itself, from the panel's own columns alone
        for k in names:
            if kind[k] == "plain" and all(u in base or u in free for u in uses[k]):
                free.add(k)
        results = [k for k in names if wanted is None or k in set(wanted)]
        have = list(self.base.columns)
        left = [k for k in names if k not in free]
        df = self.base

        def with_(df: DataFrame, have: list[str], new: list[str]) -> tuple[DataFrame, list[str]]:
            """Columns of the row, by depth."""
            for d in sorted({self.depth[k] for k in new}):
                now = [k for k in new if self.depth[k] == d]
                df, have = df.select("*", *[F.expr(self.sql[k]).alias(k) for k in now]), [*have, *now]
            return df, have

        def free_for(columns: Sequence[str], have: Sequence[str]) -> list[str]:
            """Columns of the row that ``columns`` use and that aren't there."""
            out, queue = [], list(columns)
            while queue:
                for u in uses.get(queue.pop(), ()):
                    if u in free and u not in have and u not in out:
                        out.append(u)
                        queue.append(u)
            return out

        made_of = {k: {u for j in [k, *free_for([k], ())] for u in uses[j] if u not in free} for k in names}

        def needed(have: Sequence[str], left: Sequence[str]) -> list[str]:
            """What the columns that are left, and the results, are made of."""
            used = {u for k in [*left, *[k for k in results if k in free]] for u in made_of[k]}
            return [c for c in have if c not in free and (c in own or c in asked or c in results or c in used)]

        def carried(have: Sequence[str], left: Sequence[str]) -> tuple[list[str], list[str]]:
            """(columns to exchange, all columns left after that): columns of the row are made again if fewer then go."""
            go, again = set(needed(have, left)), set()
            while True:
                lacks = {k: made_of[k] - go for k in have if k in go and kind.get(k) == "plain"}
                gone = {k for k, m in lacks.items() if not m}
                if not gone:  # one more column may stand for several
                    [(more, n)] = Counter(u for m in lacks.values() if len(m) == 1 for u in m if u in have).most_common(1) or [("", 0)]
                    if n < 2:
                        break
                    gone = {k for k, m in lacks.items() if m == {more}}
                    go.add(more)
                go -= gone
                again |= gone
            return [c for c in have if c in go], [k for k in names if k in left or k in again - go]

        def walkable(ranks: Sequence[str]) -> list[str]:
            """Columns left that can be computed while rows lie as they do, with no ranks but these and those after them."""
            out: list[str] = []
            for k in sorted(left, key=self.depth.get):
                if (kind[k] == "plain" or k in ranks or k in self.ranks and any(u in out for u in made_of[k])) and all(u in have or u in out for u in made_of[k]):
                    out.append(k)
            return out

        def before(columns: Sequence[str]) -> set[str]:
            """Columns that ``columns`` are made of, and so on."""
            out, queue = set(), list(columns)
            while queue:
                new = made_of.get(queue.pop(), set()) - out
                out |= new
                queue += new
            return out

        def worth(ranks: list[str]) -> list[str]:
            """Of ranks that can be had, those to have now: with another turn of dates to come, what it alone needs may wait if fewer columns go then."""
            outer = [k for k in left if k not in walkable(ranks)]
            if not any(kind[k] == "date" for k in outer):
                return ranks
            urgent = [k for k in ranks if k in before(outer)]
            width = lambda now: len(carried([*have, *now], [k for k in left if k not in now])[0])
            return urgent if width(walkable(urgent)) <= width(walkable(ranks)) else ranks

        ready = lambda k: all(u in have or u in free for u in uses[k])
        alone = lambda k: not re.search(r"\bOVER\b", self.sql[k].replace(f"OVER ({self.P}", ""))
        lie = "contract"  # by what rows lie; "walked": by date, without the engine knowing
        while left:
            now = [k for k in left if ready(k) and k not in self.ranks and (kind[k] == "plain" or kind[k] == lie)]
            if now:
                now = [k for k in now if self.depth[k] == min(self.depth[j] for j in now)]
                slides = {k: self.slides[k] for k in now if k in self.slides}
                df, have = with_(df, have, free_for(now, have))
                df, have = with_(df, have, [k for k in now if k not in slides])
                if slides:
                    df, have = slide(df, slides, self.T), [*have, *slides]
                left = [k for k in left if k not in now]
                if lie == "date" and not all(alone(k) for k in now if kind[k] == "date"):
                    lie = "anyhow"  # another window of the same column has moved the rows
                continue
            ranks = {k: self.ranks[k] for k in worth([k for k in left if k in self.ranks and ready(k)])} if lie in ("date", "walked") else {}
            if ranks:
                df, have = with_(df, have, free_for(list(ranks), have))
                left = [k for k in left if k not in ranks]
                kept = needed(have, left)
                df, have = ranking.ranked(df.sortWithinPartitions(DATE) if lie == "date" else df, ranks, DATE, kept), [*kept, *ranks]
                lie = "walked"
                continue
            lie = "contract" if any(ready(k) and kind[k] == "contract" for k in left) else "date"
            have, left = carried(have, left)
            df = df.select(*have)
            if lie == "date":  # with ``parts``, into a number of tasks that adaptive execution leaves alone
                df = df.where(where) if self._on_dates(where) and all(kind[k] != "contract" and (k in self.ranks or kind[k] == "plain" or alone(k)) for k in left) else df
                df = df.repartition(self.parts, DATE) if self.parts else df.repartition(DATE)
        have = needed(have, left)
        df = df.select(*have)
        rest = [k for k in results if k in free]
        df, _ = with_(df, have, list(dict.fromkeys([*free_for(rest, have), *rest])))
        df = df.where(where) if where else df
        return df.select(*own, *[k for k in results if k not in own])

    def select(self, columns: Mapping[str, str], where: str | None = None):
        """(output name -> column name) as a result."""
        df = self.frame(list(columns.values()), self.named([*columns.values(), where or ""]))
        if where:
            df = df.where(where)
        return df.select(*[F.expr(rounded(c)).alias(o) for o, c in columns.items()])

    def query(self, sql: str, wanted: Sequence[str]):
        """A SELECT over {panel}."""
        return self.spark.sql(sql, panel=self.frame(list(wanted), None if re.search(r"SELECT\s+(\w+\.)?\*((?!SELECT).)*(FROM|JOIN)\s+\{panel\}", sql, re.I | re.S) else self.named([sql])))


class SqlText(DuckFunctions, Layers):
    """Layers as one query text; ``base`` is a chain of CTEs of which the last is ``columns``' table."""

    dialect = "duckdb"

    def __init__(self, base: str, table: str, columns: Sequence[str], decimals: int | None = None):
        super().__init__(columns, decimals)
        self.base, self.table = base, table

    def text(self, wanted: Sequence[str] | None = None) -> tuple[str, str]:
        parts, last = [self.base], self.table
        for k, layer in enumerate(self.layers(wanted)):
            body = ", ".join(f"{self.sql[c]} AS {c}" for c in layer)
            parts.append(f"layer{k} AS (SELECT *, {body} FROM {last})")
            last = f"layer{k}"
        return "WITH " + ",\n".join(parts), last

    def select(self, columns: Mapping[str, str], where: str | None = None) -> str:
        with_, last = self.text(list(columns.values()))
        return f"{with_}\nSELECT " + ", ".join(f"{rounded(c)} AS {o}" for o, c in columns.items()) + f" FROM {last}" + (f" WHERE {where}" if where else "")

    def query(self, sql: str, wanted: Sequence[str]) -> str:
        with_, last = self.text(list(wanted))
        sql = sql.replace("{panel}", last)
        if sql.lstrip().upper().startswith("WITH "):
            return f"{with_},\n{sql.lstrip()[5:]}"
        return f"{with_}\n{sql}"
