"""Ranks and places within a date, all of a layer's in one walk over the date's rows.

A window function sorts whole rows anew for every column that is ranked, and a task holds all of those sorts at once. Here
rows are sorted once, by date; what is ranked is ordered as arrays of one date, and the rows pass through as they came.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rank:
    """Rank of ``value`` on its date from 1, ties at their average, among rows whose ``known`` is 1, or those of one ``by``; with ``share`` over their number.

    ``place`` (``up``, ``down``): the row's place from 1 by rising or falling value instead, ties by the column ``ties``.
    """

    value: str
    known: str
    by: str | None = None
    share: bool = False
    place: str = ""
    ties: str | None = None

    @property
    def used(self) -> tuple[str, ...]:
        return tuple(c for c in (self.value, self.known, self.by, self.ties) if c)


def average_ranks(v: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rank, number of values) of every value in its group. NaN is larger than any number, and equal to itself."""
    order = np.argsort(v, kind="stable")
    if groups is not None:
        order = order[np.argsort(groups[order], kind="stable")]
    s = v[order]
    new = s[1:] != s[:-1]
    if s.dtype.kind == "f":
        new &= ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
    first = np.zeros(len(s), dtype=bool)
    if groups is not None:
        first[1:] = groups[order][1:] != groups[order][:-1]
    first[:1] = True
    starts = np.flatnonzero(first | np.concatenate([first[:1], new.astype(bool)]))
    tied = np.diff(np.append(starts, len(s)))
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(s)))
    rank, number = np.empty(len(s)), np.empty(len(s))
    rank[order] = np.repeat(starts + (tied + 1) / 2, tied) - np.repeat(begin, size)
    number[order] = np.repeat(size, size)
    return rank, number


def places(v: np.ndarray, ties: np.ndarray, down: bool, groups: np.ndarray | None = None) -> np.ndarray:
    """Place of every value in its group. NaN is larger than any number, and equal to itself."""
    code = np.unique(v, return_inverse=True)[1]
    order = np.lexsort((ties, -code if down else code, *([] if groups is None else [groups])))
    out = np.empty(len(v), dtype=np.int64)
    out[order] = np.arange(1, len(v) + 1)
    if groups is not None and len(v):
        begin = np.flatnonzero(np.append(True, np.diff(groups[order]) != 0))
        out[order] -= np.repeat(begin, np.diff(np.append(begin, len(v))))
    return out


def ranked(df: DataFrame, columns: dict[str, Rank], date: str, keep: list[str]) -> DataFrame:
    """``keep`` and the ranks, of a table whose dates are whole in a partition and sorted there. A task holds one date and a batch."""
    need = list(dict.fromkeys(c for r in columns.values() for c in r.used))

    def run(batches):
        def finished(pieces: list[pa.RecordBatch], days: np.ndarray):
            column = lambda c: pa.chunked_array([b.column(c) for b in pieces])
            cache, found = {}, {}
            for name, r in columns.items():
                if r.place:
                    known = column(r.known).to_numpy() == 1
                    if r.ties not in cache:
                        cache[r.ties] = pc.rank(column(r.ties), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
                    out = np.zeros(len(known), dtype=np.int32)
                    out[known] = places(column(r.value).filter(pa.array(known)).to_numpy(), cache[r.ties][known], r.place == "down", days[known] if days[0] != days[-1] else None)
                    found[name] = pa.array(out, mask=~known)
                    continue
                key = (r.value, r.known, r.by)
                if key not in cache:
                    known = column(r.known).to_numpy() == 1
                    groups = days[known] if days[0] != days[-1] else None
                    if r.by:
                        by = column(r.by).combine_chunks().dictionary_encode().indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                        groups = (days * (by.max(initial=0) + 1) + by)[known]
                    cache[key] = known, *average_ranks(column(r.value).filter(pa.array(known)).to_numpy(), groups)
                known, rank, number = cache[key]
                out = np.zeros(len(known))
                out[known] = rank / number if r.share else rank
                found[name] = pa.array(out, mask=~known)
            at = 0
            for b in pieces:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[found[c].slice(at, b.num_rows) for c in columns]], names=[*keep, *columns])
                at += b.num_rows

        held, numbers, last, day = [], [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            dates = batch.column(date)
            codes = dates.dictionary_encode(null_encoding="encode").indices.to_numpy()
            day += last is not None and not dates[0].equals(last)
            own = day + np.concatenate([[0], np.cumsum(codes[1:] != codes[:-1])]).astype(np.int64)
            last, cut = dates[len(dates) - 1], int(np.searchsorted(own, own[-1]))
            if cut or held and own[0] != numbers[-1][-1]:  # the dates before the batch's last one are whole
                ready = ([*held, batch.slice(0, cut)], [*numbers, own[:cut]]) if cut else (held, numbers)
                yield from finished(ready[0], np.concatenate(ready[1]))
                held, numbers = [], []
            held.append(batch.slice(cut))
            numbers.append(own[cut:])
            day = int(own[-1])
        if held:
            yield from finished(held, np.concatenate(numbers))

    schema = df.select(*keep).schema
    for c, r in columns.items():
        schema = schema.add(c, "integer" if r.place else "double")
    return df.select(*dict.fromkeys([date, *keep, *need])).mapInArrow(run, schema)
