"""Order statistics over a contract's trailing rows, kept from row to row instead of sorted anew for each.

A panel's rows come to a task by contract and date, as the windows before them want it; a column here is computed in one
walk over them that keeps ``w`` rows, whatever the batch or the contract's length. A row costs a search among w sorted
values, where a window function collects and sorts them all.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "_row"


@dataclass(frozen=True)
class Slide:
    """A column of this kind: ``median`` of the last ``w`` rows of one input, or ``selected``: the mean of the first input over the rows where the second is among its ``n`` largest, less that over its ``n`` smallest."""

    kind: str
    inputs: tuple[str, ...]
    w: int
    n: int = 0


class Medians:
    """Medians of the last w rows, all known; missing otherwise."""

    def __init__(self, w: int):
        self.w, self.tail = w, np.zeros(0)

    def feed(self, starts: np.ndarray, x: np.ndarray) -> np.ndarray:
        """``starts``: where in this batch contracts begin."""
        out = np.full(len(x), np.nan)
        cuts = [0, *starts[starts > 0].tolist(), len(x)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i or len(starts) and starts[0] == 0:
                self.tail = np.zeros(0)
            own = np.concatenate([self.tail, x[i:j]])
            if len(own) >= self.w:
                out[i:j] = pd.Series(own).rolling(self.w, min_periods=self.w).median().to_numpy()[len(self.tail) :]
            self.tail = own[max(0, len(own) - self.w + 1) :]
        return out


class SelectedMeans:
    """For several n at once, from one list of the window's rows in order of y, ties by time."""

    def __init__(self, w: int, sizes: Sequence[int]):
        self.w, self.sizes = w, tuple(sizes)
        self.restart()

    def restart(self) -> None:
        self.rows: deque[float] = deque()
        self.y: list[float] = []
        self.x: list[float] = []

    def feed(self, starts: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        out = np.full((len(self.sizes), len(x)), np.nan)
        first = set(starts.tolist())
        known = (~np.isnan(x) & ~np.isnan(y)).tolist()
        for i, (a, b, ok) in enumerate(zip(x.tolist(), y.tolist(), known, strict=True)):
            if i in first or not ok:
                self.restart()  # a window with a missing row counts for nothing
                if not ok:
                    continue
            if len(self.rows) == self.w:
                k = bisect_left(self.y, self.rows.popleft())  # of equal ones the oldest stands first
                del self.y[k], self.x[k]
            self.rows.append(b)
            k = bisect_right(self.y, b)
            self.y.insert(k, b)
            self.x.insert(k, a)
            if len(self.rows) == self.w:
                for j, n in enumerate(self.sizes):
                    out[j, i] = sum(self.x[-n:]) / n - sum(self.x[:n]) / n
        return list(out)


def slide(df: DataFrame, columns: dict[str, Slide], order: str) -> DataFrame:
    """``df`` with ``columns``; ``order`` is the window of contracts by date.

    The number of each row in its contract comes from a window function over that order, so its rows arrive in it without
    an exchange or a sort of their own. The numbers are checked: rows that come in any other order are an error.
    """
    numbered = df.select("*", F.expr(f"row_number() OVER ({order})").alias(ROW))
    # Selections of several sizes from one window are one walk.
    walks: dict[tuple, list[str]] = {}
    for c, s in columns.items():
        walks.setdefault((s.kind, s.inputs, s.w, None if s.kind == "selected" else c), []).append(c)

    def run(batches):
        state = {k: Medians(k[2]) if k[0] == "median" else SelectedMeans(k[2], [columns[c].n for c in names]) for k, names in walks.items()}
        last = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column(ROW).to_numpy()
            if ((row != 1) & (np.diff(row, prepend=last) != 1)).any():
                raise RuntimeError("rows of a contract out of order")
            last = row[-1]
            starts = np.flatnonzero(row == 1)
            numbers = lambda c, batch=batch: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
            found = {}
            for key, names in walks.items():
                got = state[key].feed(starts, *map(numbers, key[1]))
                found |= dict(zip(names, got if isinstance(got, list) else [got], strict=True))
            kept = [c for c in batch.schema.names if c != ROW]
            arrays = [batch.column(c) for c in kept] + [pa.array(found[c], pa.float64(), from_pandas=True) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *columns])

    schema = df.schema
    for c in columns:
        schema = schema.add(c, "double")
    return numbered.mapInArrow(run, schema)
