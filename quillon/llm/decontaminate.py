"""Operator 2: benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of WINDOW consecutive words (a shorter item is one window). Words are ordered by how rarely they
occur in the documents; a document can only contain a window if it has the window's rarest word, so that one word (the
shortest shingle) is the window's necessary prefix. Documents are joined with windows on it; the word's place in document
and window bounds where the window would lie (it must fit inside the document), and the words there are then compared one
by one. Words are compared by 64-bit hashes.

The index of a block of items of bounded size is broadcast. A larger benchmark is looked up block by block, one index at a
time: each pass writes what it hits, by digest of the text, and the last one puts the passes together.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from quillon.llm import text as T
from quillon.llm.common import configure, materialise

WINDOW = 13
#: Bytes of item text that one pass over the documents looks for; its index has about 20 times as many, in each Python worker. A larger benchmark takes several passes.
INDEX_BYTES = 2 << 20
_ALNUM = T.classes("alnum")


@dataclass(frozen=True)
class Index:
    """Windows of some items, by the hash of their prefix word.

    ``keys`` sorted; windows key_start[i]:key_start[i + 1] have keys[i] as prefix. Window j has its words' hashes in
    words[j] (``length[j]`` of them), its prefix at ``offset[j]`` and belongs to ``item[j]``.
    """

    keys: np.ndarray
    key_start: np.ndarray
    words: np.ndarray
    length: np.ndarray
    offset: np.ndarray
    item: np.ndarray


def item_words(items: list[tuple[object, str]]) -> list[tuple[object, np.ndarray]]:
    b, o = T.strings(pa.array([t for _, t in items], pa.large_string()))
    s, e, bounds = T.tokens(b, o, _ALNUM)
    h = T.hashes(b, s, e)
    return [(items[i][0], h[bounds[i] : bounds[i + 1]]) for i in range(len(items))]


def build_index(items: list[tuple[object, np.ndarray]], words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> Index:
    """Index of all windows of the items; the prefix word is the one that is least often among the documents, by (count, hash). ``words`` are the items' sorted word hashes, ``counts`` how often each occurs."""
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, counts))] = np.arange(len(words))
    parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), np.zeros((0, window), np.uint64), *[np.zeros(0, np.int64)] * 3)]
    for i, (_, h) in enumerate(items):
        if len(h):
            m = min(window, len(h))
            at = np.lib.stride_tricks.sliding_window_view(rank[np.searchsorted(words, h)], m).argmin(1)
            w = np.zeros((len(at), window), np.uint64)
            w[:, :m] = np.lib.stride_tricks.sliding_window_view(h, m)
            parts.append((h[np.arange(len(at)) + at], w, np.full(len(at), m), at, np.full(len(at), i)))
    key, every, length, offset, item = (np.concatenate([p[k] for p in parts]) for k in range(5))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return Index(key[first], np.append(first, len(key)), every[order], length[order], offset[order], item[order])


def lookup(keys: np.ndarray, h: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in h, positions in keys) of equal values; ``bits`` is a 2**20-entry presence table of the keys' high bits."""
    at = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
    k = np.searchsorted(keys, h[at])
    k[k == len(keys)] = 0
    ok = keys[k] == h[at]
    return at[ok], k[ok]


def presence(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(keys >> np.uint64(44)).astype(np.int64)] = True
    return bits


def find_windows(h: np.ndarray, bounds: np.ndarray, ix: Index, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, words, item) of every occurrence of a window in texts with word hashes ``h``, in blocks of candidates."""
    at, k = lookup(ix.keys, h, bits)
    doc_first = np.repeat(bounds[:-1], np.diff(bounds))
    doc_last = np.repeat(bounds[1:], np.diff(bounds))
    many = ix.key_start[k + 1] - ix.key_start[k] if len(k) else np.zeros(0, np.int64)
    total = np.append(0, np.cumsum(many))
    i = 0
    while i < len(at):  # a frequent prefix word of many windows meets every one of its places; blocks bound the memory
        j = max(i + 1, int(np.searchsorted(total, total[i] + 200_000, "right")) - 1)
        n = many[i:j]
        w = np.repeat(ix.key_start[k[i:j]], n) + np.arange(n.sum()) - np.repeat(total[i:j] - total[i], n)
        p = np.repeat(at[i:j], n)
        first = p - ix.offset[w]
        fits = (first >= doc_first[p]) & (first + ix.length[w] <= doc_last[p])
        first, w = first[fits], w[fits]
        for c in range(ix.words.shape[1]):
            if not len(first):
                break
            inside = ix.length[w] > c
            same = ~inside | (h[np.minimum(first + c, len(h) - 1)] == ix.words[w, c])
            first, w = first[same], w[same]
        if len(first):
            yield first, ix.length[w], ix.item[w]
        i = j


def count_words(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """How many times each of ``words`` (sorted hashes of a block's vocabulary) occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        keys = shared.value
        bits, n = presence(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, bb, oo in T.blocks(*T.strings(batch.column(0))):
                s, e, _ = T.tokens(bb, oo, _ALNUM)
                n += np.bincount(lookup(keys, T.hashes(bb, s, e), bits)[1], minlength=len(keys))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"w": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    got = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(words), np.int64)
    for r in got.collect():
        counts[r.w] = r.n
    shared.unpersist()
    return counts


def item_blocks(benchmark: DataFrame, id_col: str = "item_id") -> Iterator[list[tuple[object, str]]]:
    """(id, text) of items with words, in blocks of at most INDEX_BYTES of text (one item at least)."""
    block, size = [], 0
    for r in benchmark.where(F.col("text").isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col("text").cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        if block and size + len(r.t) > INDEX_BYTES:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t.encode())
    if block:
        yield block


def make_indexes(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id") -> Iterator[tuple[Index, list[str | None]]]:
    """One (index, item ids) per block of items, made when it is asked for, so that one is held at a time."""
    configure(docs.sparkSession)
    for block in item_blocks(benchmark, id_col):
        items = item_words(block)
        every = np.sort(np.concatenate([np.zeros(0, np.uint64), *[h for _, h in items]]))
        if len(every):
            words = every[np.append(True, every[1:] != every[:-1])]
            yield build_index(items, words, count_words(docs, words), window), [i for i, _ in items]


@dataclass
class _Found:
    """What one block of texts holds of some indexes: words, and the windows that occur as (first word, words), with their items' ids by text."""

    bounds: np.ndarray
    first: list[np.ndarray]
    length: list[np.ndarray]
    items: list[set]

    def cover(self) -> np.ndarray:
        step = np.zeros(int(self.bounds[-1]) + 1, np.int64)
        for f, n in zip(self.first, self.length, strict=True):
            np.add.at(step, f, 1)
            np.add.at(step, f + n, -1)
        return np.cumsum(step[:-1]) > 0


def _find(bb: np.ndarray, oo: np.ndarray, ix: Index, ids: list, bits: np.ndarray) -> _Found:
    s, e, bounds = T.tokens(bb, oo, _ALNUM)
    got = _Found(bounds, [], [], [set() for _ in range(len(oo) - 1)])
    for first, length, item in find_windows(T.hashes(bb, s, e), bounds, ix, bits):
        got.first.append(first)
        got.length.append(length)
        pairs = np.unique((np.searchsorted(bounds, first, "right") - 1) * len(ids) + item)
        for x in pairs:
            got.items[x // len(ids)].add(ids[x % len(ids)])
    return got


def _counted(got: _Found, positions: bool) -> tuple[np.ndarray, np.ndarray, list, list]:
    """n_words, n_hit, items and (with ``positions``) hit places of each text."""
    hit, bounds = got.cover(), got.bounds
    total = np.append(0, np.cumsum(hit))
    places = [np.flatnonzero(hit[a:z]).tolist() for a, z in zip(bounds[:-1], bounds[1:], strict=True)] if positions else []
    return np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]], [sorted(x - {None}) for x in got.items], places


def _results(parts: list[tuple], batch: pa.RecordBatch, keep: int, names: list[str], positions: bool) -> pa.RecordBatch:
    z = np.zeros(0, np.int64)
    n_words, n_hit = (pa.array(np.concatenate([z, *[p[k] for p in parts]]), pa.int64()) for k in (0, 1))
    cols = [n_words, n_hit, pa.array([x for p in parts for x in p[2]], pa.list_(pa.string()))]
    more = [pa.array([x for p in parts for x in p[3]], pa.list_(pa.int64()))] if positions else []
    return pa.RecordBatch.from_arrays([*batch.columns[:keep], *cols, *more], names=[*names, "n_words", "n_hit", "items", *["hit_words"] * positions])


def mark_hits(docs: DataFrame, indexes: Iterable[tuple[Index, list[str | None]]], keep: list[str], positions: bool = False) -> DataFrame:
    """``keep`` columns, n_words, n_hit (words inside an occurring window), items (distinct ids of items with an occurring window, as sorted strings); with ``positions`` also hit_words, the hit words' places.

    With one index, one pass. With several, each is broadcast alone for a pass of its own that writes the texts it hits, by
    digest, and a last pass counts. Null and empty texts have no words and no hits; very long ones are looked up whole;
    items that are null or have no words never occur; repeated rows stay and count alike; an empty table gives no rows, an
    empty benchmark no hits. Of other columns only ``keep`` is read, so their names can't clash.
    """
    spark = docs.sparkSession
    configure(spark)
    indexes = iter(indexes)
    first, second = next(indexes, None), next(indexes, None)
    at = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    names = [f.name for f in at.schema.fields[:-1]]
    schema = at.select(*names).schema.add("n_words", "long").add("n_hit", "long").add("items", ArrayType(StringType()))
    schema = schema.add("hit_words", ArrayType(LongType())) if positions else schema
    if second is None:
        shared = spark.sparkContext.broadcast(first or (build_index([], np.zeros(0, np.uint64), np.zeros(0, np.int64)), [None]))

        def run(batches):
            ix, ids = shared.value
            bits = presence(ix.keys)
            for batch in batches:
                parts = [_counted(_find(bb, oo, ix, ids, bits), positions) for _, _, bb, oo in T.blocks(*T.strings(batch.column(batch.num_columns - 1)))]
                yield _results(parts, batch, len(names), names, positions)

        return at.mapInArrow(run, schema)
    hits = None
    for one in itertools.chain((first, second), indexes):
        shared = spark.sparkContext.broadcast(one)
        found = materialise(_hit_texts(docs.select(F.col("text").cast("string").alias("text")), shared), "hits")
        hits = found if hits is None else hits.unionByName(found)
        shared.unpersist()
    # A text that many rows have was found once for each row; its passes' results are equal.
    per_text = hits.distinct().groupBy("text_key").agg(F.collect_list(F.struct("first", "length", "items")).alias("_hits"))
    joined = at.withColumn("_key", F.md5("_text")).join(per_text.withColumnRenamed("text_key", "_key"), "_key", "left").select(*[F.col(f"`{n}`") for n in names], "_text", "_hits")

    def count(batches):
        for batch in batches:
            parts, lists = [], batch.column(len(names) + 1).to_pylist()
            for i, j, bb, oo in T.blocks(*T.strings(batch.column(len(names)))):
                bounds = T.tokens(bb, oo, _ALNUM)[2]
                got = _Found(bounds, [], [], [set() for _ in range(j - i)])
                for k, x in enumerate(lists[i:j]):
                    for h in x or ():
                        got.first.append(T.unplanes(h["first"], np.int64) + bounds[k])
                        got.length.append(T.unplanes(h["length"], np.int64))
                        got.items[k] |= set(h["items"])
                parts.append(_counted(got, positions))
            yield _results(parts, batch, len(names), names, positions)

    return joined.mapInArrow(count, schema)


def _hit_texts(docs: DataFrame, shared) -> DataFrame:
    """(text_key, first, length, items) of the texts in which windows of one index occur: their md5, places packed."""

    def run(batches):
        ix, ids = shared.value
        bits = presence(ix.keys)
        for batch in batches:
            out = []
            for i, j, bb, oo in T.blocks(*T.strings(batch.column(0))):
                got = _find(bb, oo, ix, ids, bits)
                f, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (got.first, got.length))
                d = np.searchsorted(got.bounds, f, "right") - 1
                order = np.lexsort((n, f))
                f, n, d = f[order], n[order], d[order]
                for k in range(j - i):
                    a, z = np.searchsorted(d, (k, k + 1))
                    if z > a:
                        out.append((hashlib.md5(bb[oo[k] : oo[k + 1]].tobytes()).hexdigest(), T.planes(f[a:z] - got.bounds[k]), T.planes(n[a:z]), sorted(got.items[k] - {None})))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["text_key", "first", "length", "items"])

    return docs.mapInArrow(run, "text_key string, first binary, length binary, items array<string>")


def is_contaminated(n_hit, n_words):
    """The contract's rule: some word is hit, and the hit words are a twentieth of the text or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
