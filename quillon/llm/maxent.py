"""Operator 13: language-model scoring with a hashed maximum-entropy model of classes of words.

P(word | history) = P(class | history) * P(word | class). The class factor is a softmax over a few classes whose features
are the words before (the last one, the last two together) and skips (the second and the third last), each hashed to a
row of weights. The word factor has its bias alone, of which the best fit is known: counts plus one. The most frequent
words are classes of their own; all others go by how they end, in ranges of endings of about equal weight, so that unknown
words have a class as well, and each class keeps a share of its word factor for one unknown word.

Three passes over data: texts are counted by word; texts become rows of word numbers and classes, written once; the rows
are learnt from in a few rounds, each a part of the training documents. In a round every task takes AdaGrad steps of its
own from the weights of the round before; steps are averaged row by row, weighted by how often a task met that row, in an
exchange over blocks of rows. Scoring is one more pass, of sparse lookups in numpy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as T
from quillon.llm.common import configure, materialise
from quillon.llm.quality import fold

#: Classes; of these at most so many of one word (the end among them); bits of hashed feature rows.
CLASSES, SINGLE, BITS = 32, 12, 16
#: Words whose counts every task holds at most, the most frequent; those of the others are joined.
HEAD_WORDS = 1 << 20
#: Rounds of learning; training tokens that a task of a round learns from, and tasks at most; tokens of one step.
ROUNDS, TASK_TOKENS, MOST_TASKS, STEP = 3, 2_000_000, 4096, 4096
RATE = 0.15
#: Rows of weights in one block of the exchange of steps.
BLOCK_ROWS = 64
#: Word numbers of the beginning and the end of a text; words have the others.
BEGIN, END = 0, 1
SEEDS = (0x9E37, 0x85EB, 0xC2B2, 0x27D4)


def endings(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word's last two bytes, A-Z folded: the last one first, so that alike endings are near each other."""
    low = np.arange(256)
    low[65:91] += 32
    last = low[b[ends - 1]]
    before = np.where(ends - starts > 1, low[b[np.maximum(ends - 2, 0)]], 0)
    return (last << 8 | before).astype(np.int64)


def word_tokens(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending, bounds) of the words of each text."""
    s, e, bounds = T.tokens(b, o, T.classes("space"))
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), bounds
    return T.hashes(b, s, e), endings(b, s, e), bounds


def count_words(texts: DataFrame) -> DataFrame:
    """(word, ending, n): how often each hashed word occurs in ``texts`` (text), counted in tasks first."""

    def run(batches):
        for batch in batches:
            for _, _, b, o in T.blocks(*T.strings(batch.column(0)), size=8 << 20, most=1 << 16):
                h, end, _ = word_tokens(b, o)
                order = np.argsort(h)
                h, end = h[order], end[order]
                head = np.flatnonzero(np.diff(h, prepend=~h[:1])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(head, len(h)))
                yield pa.RecordBatch.from_pydict({"word": pa.array(h[head].view(np.int64)), "ending": pa.array(end[head], pa.int32()), "n": pa.array(n, pa.int64())})

    return texts.mapInArrow(run, "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Counts of training tokens: all, distinct, texts; the head's hashes in order with their counts; the least count of a head word.

    ``single``: hashed words that are classes of their own, in order, with those classes. ``by_ending``: the class of each
    ending. ``mass``: each class's counts plus one for each of its words and, in classes by ending, one for an unknown word.
    The end is class 0.
    """

    tokens: int
    distinct: int
    texts: int
    head: np.ndarray
    counts: np.ndarray
    least: int
    single: np.ndarray
    single_class: np.ndarray
    by_ending: np.ndarray
    mass: np.ndarray

    def known(self, h: np.ndarray) -> np.ndarray:
        """Counts of hashed words; -1 where the head doesn't have one."""
        if not len(self.head):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, self.counts[at], -1)

    def classes(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = self.by_ending[ending]
        if len(self.single):
            at = np.minimum(np.searchsorted(self.single, h), len(self.single) - 1)
            out = np.where(self.single[at] == h, self.single_class[at], out)
        return out.astype(np.uint8)


def vocabulary(counts: DataFrame, texts: int, most: int = HEAD_WORDS) -> Vocabulary:
    """Of written ``counts``: at most ``most`` words and 65,536 endings come to the driver."""
    whole = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    # A word's octave of counts, in eighths: words of the highest octaves are the head.
    octave = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["o"], r["count"]) for r in counts.groupBy(octave.alias("o")).count().collect()), reverse=True)
    least_octave, held = None, 0
    for o, size in sizes:
        held += size
        if held > most:
            break
        least_octave = o
    least = math.inf if least_octave is None else 2 ** (least_octave / 8)
    head = counts.where(F.lit(least_octave).isNotNull() & (octave >= F.lit(least_octave or 0))).select("word", "n").toArrow()
    h, n = head.column("word").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    top = counts.orderBy(F.desc("n"), "word").limit(SINGLE - 1).select("word", "ending", "n").collect()
    # Endings weigh without the words that are classes of their own; those are subtracted here.
    size, words = np.zeros(1 << 16), np.zeros(1 << 16)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        size[r["ending"]], words[r["ending"]] = r["n"], r["v"]
    # Less than a class's share would make a class of one word poorer than its ending.
    top = [r for r in top if r["n"] * CLASSES >= whole["n"] / 4]
    for r in top:
        size[r["ending"]] -= r["n"]
        words[r["ending"]] -= 1
    first = 1 + len(top)
    share = (np.cumsum(size) - size / 2) / max(size.sum(), 1)
    by_ending = first + np.minimum((share * (CLASSES - first)).astype(np.int64), CLASSES - first - 1)
    mass = np.bincount(by_ending, size + words, CLASSES) + 1
    mass[0] = texts + 1
    single = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    for k, r in enumerate(top, 1):
        mass[k] = r["n"] + 1
    order = np.argsort(single)
    tokens, distinct = int(whole["n"]) + texts, int(whole["v"]) + (texts > 0)
    return Vocabulary(tokens, distinct, texts, h, n, 0 if least is math.inf else math.ceil(least), single[order], order + 1, by_ending, mass)


ROWS = (
    "text_no long, id {kind}, held_out boolean, n_tokens long, n_known long, head double, part int, "
    "words binary, classes binary, rest array<long>"
)


def binaries(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The ranges of ``x`` between ``cuts`` as binary values."""
    offsets = (cuts * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def number_words(docs: DataFrame, voc: Vocabulary, rounds: int) -> DataFrame:
    """One row per document (id, held_out, text): word numbers (16 bits of their hash) and classes, the end last; the sum of log10(count + 1) over words of the head, how many of them are known, and the hashes of the rest.

    ``text_no`` numbers rows by task; ``part`` deals training documents to rounds, -1 for documents held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voc)
    kind = dict(docs.dtypes)["id"]

    def run(batches):
        v, next_no = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j, b, o in T.blocks(*T.strings(batch.column(2))):
                h, ending, bounds = word_tokens(b, o)
                c, cls = v.known(h), v.classes(h, ending)
                number = ((h >> np.uint64(48)).astype(np.uint16) | np.uint16(2))
                size = np.diff(bounds)
                owner, have = T.owners(bounds), c > 0
                logs = np.bincount(owner[have], np.log10(c[have] + 1.0), j - i) + math.log10(v.texts + 1)
                known = np.bincount(owner[have], minlength=j - i) + (v.texts > 0)
                # The end goes behind each text's words.
                at = bounds[1:]
                number, cls = np.insert(number, at, END), np.insert(cls, at, 0)
                cuts = np.append(0, np.cumsum(size + 1))
                rest, rest_at = h[~have].view(np.int64), np.append(0, np.cumsum(np.bincount(owner[~have], minlength=j - i)))
                held = batch.column(1).slice(i, j - i)
                no = next_no + np.arange(j - i)
                next_no += j - i
                out = np.asarray(held.to_numpy(zero_copy_only=False), bool)
                part = np.where(out, -1, (T.mix(no.astype(np.uint64)) % np.uint64(rounds)).astype(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "text_no": pa.array(no, pa.int64()),
                    "id": batch.column(0).slice(i, j - i),
                    "held_out": held,
                    "n_tokens": pa.array(size + 1, pa.int64()),
                    "n_known": pa.array(known, pa.int64()),
                    "head": pa.array(logs, pa.float64()),
                    "part": pa.array(part, pa.int32()),
                    "words": binaries(number, cuts),
                    "classes": binaries(cls, cuts),
                    "rest": pa.ListArray.from_arrays(pa.array(rest_at, pa.int32()), pa.array(rest, pa.int64())),
                })

    return docs.mapInArrow(run, ROWS.format(kind=kind))


def sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, classes, bounds of texts) of the columns words and classes of ``batch``."""

    def flat(name, kind):
        a = batch.column(name)
        off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
        return np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind), (off - off[0]) // np.dtype(kind).itemsize

    w, bounds = flat("words", np.uint16)
    return w, flat("classes", np.uint8)[0], bounds.astype(np.int64)


def feature_rows(w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(4, tokens): for each token the rows of weights of its history."""
    starts = bounds[:-1]
    before = []
    for k in (1, 2, 3):
        x = np.full(len(w), BEGIN, np.uint32)
        x[k:] = w[:-k]
        for j in range(k):
            at = starts + j
            x[at[at < bounds[1:]]] = BEGIN
        before.append(x)
    one, two, three = before
    out = np.empty((4, len(w)), np.uint32)
    for f, x in enumerate((one, one * np.uint32(0x01000193) ^ two * np.uint32(0x9E3779B1), two, three)):
        x = (x + np.uint32(SEEDS[f])) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        out[f] = x >> np.uint32(32 - BITS)
    return out


@dataclass
class Weights:
    """A row of ``w`` for each hashed feature, with a sum of squared steps each in ``g``; a bias for each class."""

    w: np.ndarray
    g: np.ndarray
    bias: np.ndarray

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = self.w[rows[0]]
        for f in range(1, len(rows)):
            out += self.w[rows[f]]
        out += self.bias
        return out

    def learn(self, rows: np.ndarray, y: np.ndarray) -> None:
        """One AdaGrad step on tokens with these feature rows and classes."""
        p = self.logits(rows)
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        heads = np.flatnonzero(np.diff(flat[order], prepend=-1))
        at = flat[order][heads]
        step = np.add.reduceat(p[order % len(y)], heads)
        self.g[at] += (step * step).mean(1)
        self.w[at] -= RATE * step / np.sqrt(self.g[at] + 1e-3)[:, None]


def start(voc: Vocabulary) -> Weights:
    """No feature tells anything yet: classes are as likely as they are frequent."""
    size = voc.mass / voc.mass.sum()
    return Weights(np.zeros((1 << BITS, CLASSES), np.float32), np.zeros(1 << BITS, np.float32), np.log(size).astype(np.float32))


STEPS = "block int, met binary, w binary, g binary"


def round_of_steps(rows: DataFrame, model: Weights, tasks: int) -> Weights:
    """The weights after every task has learnt from its share of ``rows``: its steps, weighted by how often it met each row of weights."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    blocks = (1 << BITS) // BLOCK_ROWS

    def learn(batches):
        old = shared.value
        new, met = Weights(old.w.copy(), old.g.copy(), old.bias), np.zeros(1 << BITS, np.float32)
        for batch in batches:
            w, y, bounds = sequences(batch)
            if not len(w):
                continue
            every = feature_rows(w, bounds)
            met += np.bincount(every.ravel(), minlength=1 << BITS)
            for i in range(0, len(w), STEP):
                new.learn(every[:, i : i + STEP], y[i : i + STEP])
        full = np.flatnonzero(met.reshape(blocks, -1).any(1))
        cut = lambda x: [part.tobytes() for part in x.reshape(blocks, BLOCK_ROWS, -1)[full]]
        # What a task adds is small, so half precision holds it.
        changes = {"met": met, "w": (new.w - old.w).astype(np.float16), "g": new.g - old.g}
        yield pa.RecordBatch.from_pydict({"block": pa.array(full, pa.int32())} | {k: pa.array(cut(x), pa.binary()) for k, x in changes.items()})

    def total(table: pa.Table) -> pa.Table:
        met, w, g = np.zeros(BLOCK_ROWS), np.zeros((BLOCK_ROWS, CLASSES)), np.zeros(BLOCK_ROWS)
        for r in sorted(table.to_pylist(), key=lambda r: (r["met"], r["w"])):
            m = np.frombuffer(r["met"], np.float32).astype(np.float64)
            met += m
            w += np.frombuffer(r["w"], np.float16).reshape(BLOCK_ROWS, CLASSES) * m[:, None]
            g += np.frombuffer(r["g"], np.float32) * m
        some = np.maximum(met, 1)
        means = {"met": met, "w": w / some[:, None], "g": g / some}
        columns = {k: pa.array([x.astype(np.float32).tobytes()], pa.binary()) for k, x in means.items()}
        return pa.table({"block": table.column("block")[:1], **columns})

    steps = rows.select("words", "classes").coalesce(tasks).mapInArrow(learn, STEPS).groupBy("block").applyInArrow(total, STEPS)
    w, g = model.w.copy(), model.g.copy()
    for r in steps.collect():  # 2 ** BITS rows of weights at most
        at = slice(r["block"] * BLOCK_ROWS, (r["block"] + 1) * BLOCK_ROWS)
        w[at] += np.frombuffer(r["w"], np.float32).reshape(BLOCK_ROWS, CLASSES)
        g[at] += np.frombuffer(r["g"], np.float32)
    return Weights(w, g, model.bias)


def score_rows(rows: DataFrame, model: Weights, voc: Vocabulary) -> DataFrame:
    """(text_no, by_class): the log10 probability of the classes of each text's tokens, less log10 of the classes' masses."""
    shared = rows.sparkSession.sparkContext.broadcast((Weights(model.w, model.g[:0], model.bias), np.log10(voc.mass)))

    def run(batches):
        m, mass = shared.value
        for batch in batches:
            w, y, bounds = sequences(batch)
            every, got = feature_rows(w, bounds), np.empty(len(w))
            for i in range(0, len(w), STEP):
                z = m.logits(every[:, i : i + STEP])
                z -= z.max(1, keepdims=True)
                yy = y[i : i + STEP]
                got[i : i + STEP] = (z[np.arange(len(yy)), yy] - np.log(np.exp(z).sum(1))) / math.log(10) - mass[yy]
            yield pa.RecordBatch.from_pydict({"text_no": batch.column("text_no"), "by_class": pa.array(np.bincount(T.owners(bounds), got, len(bounds) - 1), pa.float64())})

    return rows.select("text_no", "words", "classes").mapInArrow(run, "text_no long, by_class double")


def language_model_scores(docs: DataFrame, held_out, rounds: int = ROUNDS, head_words: int = HEAD_WORDS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per document.

    The model learns from all documents for which the Column ``held_out`` is false (null counts as false) and scores all.
    Tokens are words, A-Z folded, and one end; null and empty texts are the end alone. ``base_score`` is the log10
    probability under counts plus one; ``score`` that under the model, which is no larger than 0 and adds up to 1 over the
    words of training and one unknown word for each class of endings. Repeated rows count as often as they stand there and
    score alike; rows with a null id are rows like others; very long texts are taken whole. Without training documents
    both scores come from no counts: every token is the one unknown word. An empty table gives no rows. Only ``id_col``
    and ``text`` are read besides what ``held_out`` reads, so other columns' names can't clash.
    """
    spark = docs.sparkSession
    configure(spark)
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = plain.where("not held_out")
    counts = materialise(count_words(training.select("text")), "words")
    voc = vocabulary(counts, training.count(), head_words)
    rows = materialise(number_words(plain, voc, rounds), "numbered")
    model = start(voc)
    tasks = max(1, min(MOST_TASKS, -(-voc.tokens // (rounds * TASK_TOKENS))))
    for k in range(rounds if voc.tokens else 0):
        model = round_of_steps(rows.where(F.col("part") == k), model, tasks)
    # Words beyond the head: each text's, summed before they meet their counts.
    rest = rows.select("text_no", F.explode("rest").alias("word")).groupBy("text_no", "word").agg(F.count("*").alias("times"))
    few = counts.where(F.col("n") < voc.least) if voc.least else counts
    met = rest.join(few.select("word", "n"), "word")
    met = met.groupBy("text_no").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail"), F.sum("times").alias("tail_known"))
    scored = score_rows(rows, model, voc).join(met, "text_no", "left")
    out = rows.select("text_no", "id", "held_out", "n_tokens", "n_known", "head").join(scored, "text_no")
    logs = F.col("head") + F.coalesce("tail", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(voc.tokens + voc.distinct + 1)).alias("base_score"), (logs + F.col("by_class")).alias("score"),
    )


def held_out_rows(id_col: str = "doc_id"):
    return fold(id_col, 7) == 2
