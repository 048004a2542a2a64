"""Operator 5: removal of repeated substrings with suffix arrays.

A byte goes if some string of LENGTH bytes over it also starts earlier. Equal strings are brought together by anchors: in
every window of LENGTH bytes, the run of GRAM bytes with the smallest hash (the leftmost of equals) is the window's
anchor, so equal windows have equal anchors at equal places. An anchor's context is all bytes of windows around it.

1. Every shard of texts writes its contexts as sorted runs, cut by hash range of their anchor. A range merges its runs by
   binary search: all but the first occurrence of a context are repeats, whole. An anchor with one context left is done.
2. Anchors with several contexts (edges of passages, edited copies) go with their contexts to shards by anchor. Each shard
   sorts all suffixes (Larsson-Sadakane) and finds their common prefixes (Kasai); runs of suffixes with LENGTH bytes in
   common are equal strings, of which the first occurrence stays.
3. An anchor with very many contexts is not gathered in one shard: its windows form sorted runs in each task, which are
   cut at fixed bounds and merged by binary search in the range they belong to. Anchors that a sample of the documents
   shows to have very many contexts are spread by context in step 1 as well. The sample decides on which way an anchor
   goes, never on the result.

Ranges and shards are as many as the counted bytes ask for, so that one stays of bounded size however large the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as T
from quillon.llm.common import buckets, configure, materialise
from quillon.llm.suffix import SEPARATOR, common_prefixes, suffix_array

LENGTH, GRAM = 100, 32
LEFT = LENGTH - GRAM  # an anchor starts at most so many bytes after its window
#: Bytes of contexts in one suffix array, about; whole anchors, so that ranks and positions fit one machine word.
ARRAY_BYTES = 1 << 19
#: Contexts of one anchor that go to one shard at most.
SHARD_CONTEXTS = 256
#: Bytes packed in one hash range, and bytes of contexts in one shard, about.
RANGE_BYTES, SHARD_BYTES = 6 << 20, 4 << 20
#: Documents sampled for anchors with very many contexts, as a number and a share (the larger counts); contexts in the sample that make one, and most anchors so treated.
SAMPLE_DOCS, SAMPLE_SHARE, SAMPLE_CONTEXTS, MOST_SPREAD = 4000, 1 / 3000, 8, 100_000
#: Bytes of text whose anchors are found at once.
SCAN_BYTES = 1 << 19
_SALT = np.uint64(0xA0761D6478BD642F)


def anchors(sums: T.Prefixes, o: np.ndarray) -> np.ndarray:
    """Positions of all anchors in a block of texts with bounds ``o``."""
    n = int(o[-1])
    if n < LENGTH:
        return np.zeros(0, np.int64)
    at = np.arange(n - GRAM + 1)
    h = sums.hash(at, at + GRAM)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, span = LEFT + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    size = np.diff(o)
    inside = np.ones(len(key), bool)
    for a, z in zip(np.maximum(o[:-1], o[1:] - LENGTH + 1), o[1:], strict=True) if len(size) < 64 else ():
        inside[a:z] = False
    if len(size) >= 64:
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, np.maximum(o[:-1], o[1:] - LENGTH + 1), 1)
        np.add.at(step, o[1:], -1)
        inside = np.cumsum(step)[: len(key)] == 0
    pos = (key[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return pos[np.append(True, pos[1:] != pos[:-1])] if len(pos) else pos


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document joined where they touch or overlap."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    head = np.append(True, doc[1:] != doc[:-1])
    base = np.cumsum(head) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    new = head.copy()
    new[1:] |= (start + base)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], (reach - base)[last]


_SPANS = "hot boolean, doc_id long, s long, e long, h long"


def _spans(doc, s, e, hot=None, h=None) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_pydict(
        {
            "hot": pa.array(hot if hot is not None else [None] * n, pa.bool_()),
            "doc_id": pa.array(np.asarray(doc, np.int64), pa.int64()),
            "s": pa.array(np.asarray(s, np.int64), pa.int64()),
            "e": pa.array(np.asarray(e, np.int64), pa.int64()),
            "h": pa.array(np.asarray(h if h is not None else np.zeros(n), np.int64), pa.int64()),
        }
    )


_PACKED = ("c", np.uint64), ("h", np.uint64), ("doc", np.int64), ("pos", np.uint32), ("left", np.uint8), ("right", np.uint8)
Run = tuple[np.ndarray, ...]


def merge(a: Run, b: Run) -> tuple[Run, Run]:
    """Merge two sorted runs of strings, each string once in a run, by binary search of the second's in the first.

    A run has two digests of the string, by which it is sorted, then document and place, then whatever goes with them. The
    earlier occurrence of a string of both runs stays. Returns the merged run, and the other occurrences (a string's
    occurrence that is in both runs, as from a repeated row, is one occurrence).
    """
    n = len(a[0])
    k = np.searchsorted(a[0], b[0])
    if not n:
        return b, tuple(x[:0] for x in b)
    while True:  # past strings that share the first digest only
        at = np.minimum(k, n - 1)
        on = (k < n) & (a[0][at] == b[0]) & (a[1][at] < b[1])
        if not on.any():
            break
        k = k + on
    found = (k < n) & (a[0][at] == b[0]) & (a[1][at] == b[1])
    i, j = k[found], np.flatnonzero(found)
    same = (a[2][i] == b[2][j]) & (a[3][i] == b[3][j])
    sooner = (b[2][j] < a[2][i]) | (b[2][j] == a[2][i]) & (b[3][j] < a[3][i])
    late = tuple(np.where(sooner[~same], x[i[~same]], y[j[~same]]) for x, y in zip(a, b, strict=True))
    out = []
    for c, (x, y) in enumerate(zip(a, b, strict=True)):
        if c > 1 and sooner.any():
            x = x.copy()
            x[i[sooner]] = y[j[sooner]]
        out.append(np.insert(x, k[~found], y[~found]))
    return tuple(out), late


def merge_all(runs: list[Run]) -> tuple[Run, list[Run]]:
    """All runs merged, pair by pair, and the later occurrences found on the way."""
    late = []
    while len(runs) > 1:
        pairs = [merge(runs[k], runs[k + 1]) for k in range(0, len(runs) - 1, 2)]
        late += [x for _, x in pairs if len(x[0])]
        runs = [x for x, _ in pairs] + runs[len(pairs) * 2 :]
    return runs[0], late


def sort_run(run: Run) -> tuple[Run, Run]:
    """A sorted run of any occurrences, each string once, and the other occurrences."""
    if not len(run[0]):
        return run, run
    if ((run[2][1:] < run[2][:-1]) | (run[2][1:] == run[2][:-1]) & (run[3][1:] < run[3][:-1])).any():
        order = np.lexsort((run[3], run[2]))
        run = tuple(x[order] for x in run)
    order = np.argsort(run[0], kind="stable")
    if ((run[0][order[1:]] == run[0][order[:-1]]) & (run[1][order[1:]] != run[1][order[:-1]])).any():
        order = np.lexsort((run[1], run[0]))
    run = tuple(x[order] for x in run)
    new = np.append(True, (run[0][1:] != run[0][:-1]) | (run[1][1:] != run[1][:-1]))
    again = ~new & np.append(False, (run[2][1:] != run[2][:-1]) | (run[3][1:] != run[3][:-1]))
    return tuple(x[new] for x in run), tuple(x[again] for x in run)


def range_of(x: np.ndarray, ranges: int) -> np.ndarray:
    """A number below ``ranges`` for each digest, scrambled: an anchor's own hash is the least of many and so mostly small."""
    return ((T.mix(x ^ _SALT) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def context_runs(ids: np.ndarray, b: np.ndarray, o: np.ndarray) -> Run:
    """All anchors of some texts with their contexts: digest of the context, hash of the anchor, document, place, bytes before and from there."""
    got: list[list[np.ndarray]] = [[np.zeros(0, t)] for _, t in _PACKED]
    for i, j, bb, oo in T.blocks(b, o, SCAN_BYTES):
        sums = T.Prefixes(bb, fold=False)
        p = anchors(sums, oo)
        d = np.searchsorted(oo, p, "right") - 1
        left, right = np.minimum(LEFT, p - oo[d]), np.minimum(LENGTH, oo[d + 1] - p)
        c = T.mix(sums.hash(p - left, p + right) + (left * 256 + right).astype(np.uint64))
        for at, x in zip(got, (c, sums.hash(p, p + GRAM), ids[i:j][d], p - oo[d], left, right), strict=True):
            at.append(x)
    return tuple(np.concatenate(x).astype(t) for x, (_, t) in zip(got, _PACKED, strict=True))


def spread_anchors(docs: DataFrame, share: float) -> np.ndarray:
    """Sorted hashes of anchors with very many contexts, as a sample of the documents shows them; MOST_SPREAD at most."""
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))

    def run(batches):
        for batch in batches:
            (c, h, *_), _ = sort_run(context_runs(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), *T.strings(batch.column(1))))
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "c": pa.array(c.view(np.int64))})

    pairs = picked.mapInArrow(run, "h long, c long").distinct()
    many = pairs.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_CONTEXTS)
    found = many.orderBy(F.desc("n"), "h").limit(MOST_SPREAD).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def scan(docs: DataFrame, ranges: int, spread: np.ndarray) -> DataFrame:
    """Sorted runs of contexts packed by hash range: r below ``ranges`` by anchor; of anchors in ``spread`` by context, in as many ranges above. Repeats found within a batch come as packed spans with r < 0."""
    shared = docs.sparkSession.sparkContext.broadcast(spread)

    def run(batches):
        wide = shared.value
        for number, batch in enumerate(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            first, late = sort_run(context_runs(ids, *T.strings(batch.column(1))))
            mine = merged(late[2], late[3].astype(np.int64) - late[4], late[3].astype(np.int64) + late[5])
            hot = among(first[1], wide)
            home = range_of(np.where(hot, first[0], first[1]), ranges) + ranges * hot
            place, parts = pack(first, home)
            rows = {"r": place.tolist(), **{k: [x[c] for x in parts] for c, (k, _) in enumerate(_PACKED)}}
            if len(mine[0]):
                rows["r"].append(-1 - (int(mine[0][0]) + number) % ranges)
                for k, x in zip(("c", "h", "doc", "pos", "left", "right"), (mine[2], mine[1], mine[0], None, None, None), strict=True):
                    rows[k].append(T.planes(x) if x is not None else b"")
            yield pa.RecordBatch.from_pydict({"r": pa.array(rows["r"], pa.int32()), **{k: pa.array(rows[k], pa.binary()) for k, _ in _PACKED}})

    return docs.mapInArrow(run, "r int, " + ", ".join(f"{k} binary" for k, _ in _PACKED))


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[T.unplanes(x.as_py(), kind) for x in table.column(name)]])


def resolve(scanned: DataFrame, ranges: int, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """Spans (hot null) whose contexts occurred before, and the first occurrences (s: position) of contexts whose anchor has others; hot tells whether too many."""

    def run(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        if r < 0:
            return pa.Table.from_batches([_spans(*(_column(table, k, np.int64) for k in ("doc", "h", "c")))])
        runs = [tuple(T.unplanes(table.column(k)[i].as_py(), t) for k, t in _PACKED) for i in range(table.num_rows)]
        (_, h, doc, pos, _, _), late = merge_all(runs)
        out = [_spans(*merged(*(np.concatenate(x) for x in zip(*[(x[2], x[3].astype(np.int64) - x[4], x[3].astype(np.int64) + x[5]) for x in late], strict=True))))] if late else []
        if r >= ranges:
            hot, pick = np.ones(len(h), bool), slice(None)
        else:
            order = np.argsort(h, kind="stable")
            h, doc, pos = h[order], doc[order], pos[order]
            group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
            many = np.bincount(group)[group]
            hot, pick = many > shard_contexts, many > 1
        out.append(_spans(doc[pick], pos[pick], pos[pick], hot[pick], h[pick].view(np.int64)))
        return pa.Table.from_batches(out)

    return scanned.groupBy("r").applyInArrow(run, _SPANS)


def pack(run: Run, home: np.ndarray) -> tuple[np.ndarray, list[tuple[bytes, ...]]]:
    """A run cut by ``home``, of which every part stays sorted: the numbers of the parts, and their columns as bytes."""
    order = np.argsort(home, kind="stable")
    home, run = home[order], tuple(x[order] for x in run)
    cut = np.append(np.flatnonzero(np.append(True, home[1:] != home[:-1])), len(home)) if len(home) else np.zeros(1, np.int64)
    return home[cut[:-1]], [tuple(T.planes(x[a:z]) for x in run) for a, z in zip(cut[:-1], cut[1:], strict=True)]


def windows(ids: np.ndarray, b: np.ndarray, o: np.ndarray, d: np.ndarray, start: np.ndarray, end: np.ndarray) -> Run:
    """All strings of LENGTH bytes of some contexts (text d, from start to end): two digests, document, place."""
    got: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in _WINDOW]
    for i, j, bb, oo in T.blocks(b, o, SCAN_BYTES):
        w = np.flatnonzero((d >= i) & (d < j))
        n = np.maximum(0, end[w] - start[w] - LENGTH + 1)
        x = np.repeat(w, n)
        at = start[x] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # Contexts of one text overlap; a window in several is one occurrence.
        p = np.unique(oo[d[x] - i] + at)
        t = np.searchsorted(oo, p, "right") - 1
        sums = T.Prefixes(bb, fold=False)
        one, half = sums.hash(p, p + LENGTH), sums.hash(p, p + LENGTH // 2)
        for k, v in zip(got, (one, T.mix(half ^ (one * _SALT)), ids[i:j][t], p - oo[t]), strict=True):
            k.append(v)
    return tuple(np.concatenate(v).astype(t) for v, t in zip(got, _WINDOW, strict=True))


_WINDOW = (np.uint64, np.uint64, np.int64, np.int64)


def contexts(docs: DataFrame, resolved: DataFrame, shards: int, ranges: int) -> DataFrame:
    """Of unresolved anchors: (shard >= 0, h, doc_id, start, bytes) for ordinary ones; for those with very many contexts, sorted runs of windows cut by digest range, as (shard < 0, packed columns)."""
    todo = resolved.where("hot is not null").groupBy("doc_id").agg(F.collect_list(F.struct("s", "h", "hot")).alias("todo"))
    held = docs.join(todo.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "todo")

    def run(batches):
        for number, batch in enumerate(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            b, o = T.strings(batch.column(1))
            lists = batch.column(2)
            bounds = np.asarray(lists.offsets)
            s, h, hot = (lists.values.field(k).to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]] for k in ("s", "h", "hot"))
            hot = hot.astype(bool)
            d = np.repeat(np.arange(len(ids)), np.diff(bounds))
            start, end = np.maximum(0, s - LEFT), np.minimum(o[d + 1] - o[d], s + LENGTH)
            cold = np.flatnonzero(~hot)
            home = range_of(h.astype(np.int64).view(np.uint64), shards)
            # A row of one id and another text has no such place.
            cold = cold[end[cold] - start[cold] >= LENGTH]
            yield _contexts(home[cold], [b[o[x] + y : o[x] + z].tobytes() for x, y, z in zip(d[cold], start[cold], end[cold], strict=True)], h[cold], ids[d[cold]], start[cold])
            if hot.any():
                # The first of each window in the batch waits for those of other batches; the others leave as spans.
                first, late = sort_run(windows(ids, b, o, d[hot], start[hot], end[hot]))
                place, parts = pack(first, range_of(first[0], ranges))
                yield _contexts(-1 - place, [b"".join(x) for x in parts])
                doc, s, e = merged(late[2], late[3], late[3] + LENGTH)
                if len(doc):
                    yield _contexts((doc + number) % shards, [int(z).to_bytes(8, "little") for z in e], None, doc, s)

    return held.mapInArrow(run, "shard int, h long, doc_id long, start long, bytes binary")


def _contexts(shard, raw: list[bytes], h=None, doc=None, start=None) -> pa.RecordBatch:
    none = [None] * len(raw)
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array(np.asarray(shard), pa.int32()),
            "h": pa.array(none if h is None else np.asarray(h, np.int64), pa.int64()),
            "doc_id": pa.array(none if doc is None else doc, pa.int64()),
            "start": pa.array(none if start is None else start, pa.int64()),
            "bytes": pa.array(raw, pa.binary()),
        }
    )


def _against_first(doc: np.ndarray, at: np.ndarray, again: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows that are not their class's first occurrence; rows sorted by class, then occurrence. ``same``: the row before is the same occurrence."""
    if not len(doc):
        return doc, at, at
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(doc))))
    later = again & ((doc != doc[head]) | (at != at[head])) & ~same
    return doc[later], at[later], at[later] + LENGTH


def shard_spans(raw: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats among the windows of some contexts, through their suffix array: merged spans (doc, start, end)."""
    text = np.frombuffer(b"".join(x + bytes([SEPARATOR]) for x in raw), np.uint8)
    size = np.array([len(x) + 1 for x in raw])
    first = np.cumsum(size) - size
    sa, rank = suffix_array(text, LENGTH)
    common = common_prefixes(text, sa, rank, LENGTH)
    owner = np.repeat(np.arange(len(raw)), size)[sa]
    offset = sa - first[owner]
    whole = offset + LENGTH < size[owner]  # the window ends before the separator
    group = np.cumsum(common < LENGTH)
    group, owner, offset = group[whole], owner[whole], offset[whole]
    d, a = doc[owner], start[owner] + offset
    order = np.lexsort((a, d, group))
    d, a, group = d[order], a[order], group[order]
    again = np.append(False, group[1:] == group[:-1])
    same = np.append(False, (d[1:] == d[:-1]) & (a[1:] == a[:-1])) & again
    return merged(*_against_first(d, a, again, same)) if len(d) else (d, a, a)


def merge_runs(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats among packed runs of windows from many tasks: merged spans (doc, start, end)."""
    runs = []
    for x in raw:
        n = len(x) // 32
        runs.append(tuple(T.unplanes(x[8 * n * k : 8 * n * (k + 1)], t) for k, t in enumerate(_WINDOW)))
    _, late = merge_all(runs)
    if not late:
        return (np.zeros(0, np.int64),) * 3
    doc, at = (np.concatenate([x[k] for x in late]) for k in (2, 3))
    return merged(doc, at, at + LENGTH)


def decide(ctx: DataFrame) -> DataFrame:
    """Spans of repeats of every shard (suffix array) and digest range (merged runs)."""

    def run(table: pa.Table) -> pa.Table:
        raw = [x.as_py() for x in table.column("bytes")]
        if table.column("shard")[0].as_py() < 0:
            return pa.Table.from_batches([_spans(*merge_runs(raw))])
        h = table.column("h").to_pylist()
        doc, start = table.column("doc_id").to_numpy(), table.column("start").to_numpy()
        ready = [k for k, x in enumerate(h) if x is None]
        out = [_spans(doc[ready], start[ready], [int.from_bytes(raw[k], "little") for k in ready])]
        rest = sorted((x, k) for k, x in enumerate(h) if x is not None)
        part, size = [], 0
        for i, (x, k) in enumerate(rest):
            part.append(k)
            size += len(raw[k])
            if i + 1 == len(rest) or size >= ARRAY_BYTES and rest[i + 1][0] != x:
                out.append(_spans(*shard_spans([raw[k] for k in part], doc[part], start[part])))
                part, size = [], 0
        return pa.Table.from_batches(out)

    return ctx.groupBy("shard").applyInArrow(run, _SPANS)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """(doc_id, spans array<struct<s, e>>): byte ranges, perhaps overlapping, of every document with repeats."""
    spark = docs.sparkSession
    configure(spark)
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= LENGTH)
    size = d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    spread = spread_anchors(d, min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(1, size["n"]))))
    # A text has about an anchor for every 35 bytes, of 34 bytes.
    width = buckets(spark, size["bytes"], RANGE_BYTES)
    resolved = materialise(resolve(scan(d, width, spread), width, shard_contexts), "anchors")
    left = resolved.where("hot is not null").agg(*[F.coalesce(F.sum(F.when(F.col("hot") == x, 1)), F.lit(0)).alias(k) for k, x in (("cold", False), ("hot", True))]).first()
    shards = buckets(spark, left["cold"] * (LEFT + LENGTH), SHARD_BYTES)
    ranges = buckets(spark, left["hot"] * 32 * (LEFT + 1), RANGE_BYTES)
    spans = resolved.where("hot is null").unionByName(decide(contexts(d, resolved, shards, ranges)))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", texts: bool = True, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]): one row per document.

    Null and empty texts have 0 bytes; texts under LENGTH bytes keep them all; very long ones are one array of bytes in
    their task (about 60 times their size while their anchors are found). Rows without an id keep all bytes and cover
    nothing. A repeated row of one id and text is the same occurrence and gets the same result; between equal strings the
    smaller id, then the smaller place keeps its own. An empty table gives no rows. Other columns of ``docs`` are not
    read, whatever their names. Kept bytes may begin or end inside a character.
    """
    configure(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    j = d.join(repeated_spans(docs, id_col, shard_contexts).hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]

    def run(batches):
        for batch in batches:
            b, o = T.strings(batch.column(1))
            n_removed, n_spans, digest, kept = [], [], [], []
            for i, spans in enumerate(batch.column(2)):
                t = b[o[i] : o[i + 1]]
                if spans.is_valid and len(spans):
                    flat = spans.values
                    s, e = flat.field("s").to_numpy(), flat.field("e").to_numpy()
                    _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                    step = np.zeros(len(t) + 1, np.int64)
                    step[s] += 1
                    step[e] -= 1
                    t = t[np.cumsum(step[:-1]) == 0]
                    n_removed.append(int((e - s).sum()))
                    n_spans.append(len(s))
                else:
                    n_removed.append(0)
                    n_spans.append(0)
                raw = t.tobytes()
                digest.append(hashlib.sha256(raw).hexdigest())
                if texts:
                    kept.append(raw)
            cols = [batch.column(0), pa.array(np.diff(o), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), *[pa.array(kept, pa.binary())] * texts]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return j.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
