"""Operator 4: toxicity, with a counterfactual penalty.

A presence-of-n-gram logistic regression. For every labelled sentence that names a group, the same sentence with another
group's term is scored too, and the difference is penalised: group terms cannot carry weight of their own, which keeps
neutral mentions of groups from being called toxic. Besides the listed terms, words that the labelled sentences of either
label use about equally often are swapped among their like, with less weight: in a corpus that names none of the listed
groups, these are what the penalty acts on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import configure
from quillon.llm.linear import Features, Model, fit
from quillon.llm.quality import sample, score, vectors

TRAIN_ROWS = 6000
TOXICITY = Features(bits=20, marks=False, norm=False, stems=(4, 5, 6, 7, 8))

#: Terms that name groups, by kind and language; a term is swapped for others of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "trans", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "chinese", "arab"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young", "old"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "katholisch"),
    ("schwul", "lesbisch", "hetero", "bisexuell", "trans"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "amerikaner", "türken", "araber"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische", "bürger"),
    ("behinderte", "gehörlose", "blinde", "alte", "junge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("gays", "lesbiennes", "hétéros", "bisexuels", "trans"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "américains", "arabes"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("handicapés", "sourds", "aveugles", "jeunes", "vieux"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("lesbianas", "homosexuales", "heterosexuales", "bisexuales"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "americanos", "árabes"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("discapacitados", "sordos", "ciegos", "jóvenes", "ancianos"),
)
IDENTITY_WEIGHT, COMMON_WEIGHT = 2.0, 0.1
#: Words learnt from the sample: least share of the sentences of either label, most log ratio of the shares, most words, words in a kind.
COMMON_SHARE, COMMON_RATIO, COMMON_WORDS, COMMON_KIND = 0.02, 0.25, 256, 4
_WORD = re.compile(r"[^\W\d_]+")

Kinds = dict[str, tuple[str, ...]]


def by_term(kinds: Iterable[Sequence[str]]) -> Kinds:
    """Each term's kind; a term in several keeps the first."""
    out: Kinds = {}
    for k in kinds:
        for t in k:
            out.setdefault(t, tuple(k))
    return out


GROUPS = by_term(IDENTITY)


def swapped(text: str, kinds: Kinds, shift: int = 0) -> str:
    """The text with every term replaced by another of its kind."""

    def other(m: re.Match) -> str:
        t = m[0].lower()
        kind = kinds.get(t)
        if kind is None or len(kind) < 2:
            return m[0]
        return kind[(kind.index(t) + 1 + (zlib.crc32(t.encode()) + shift) % (len(kind) - 1)) % len(kind)]

    return _WORD.sub(other, text)


def swaps(text: str, common: Kinds | None = None) -> list[tuple[str, float]]:
    """Counterfactual texts with their weights: two with other group terms, and one with other common words; none of those that would be the text itself."""
    got = [(swapped(text, GROUPS, s), IDENTITY_WEIGHT / 2) for s in range(2)]
    if common:
        got.append((swapped(text, common), COMMON_WEIGHT))
    return [x for x in got if x[0] != text]


def common_kinds(sampled: DataFrame) -> Kinds:
    """Words about as frequent among the sample's sentences of label 1 as of label 0, in kinds of similar frequency. At most COMMON_WORDS are brought to the driver."""
    totals = {r.y: r["count"] for r in sampled.groupBy("y").count().collect()}
    if len(totals) < 2:
        return {}
    words = sampled.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("word"))
    n = words.groupBy("word").agg(*[(F.sum(F.when(F.col("y") == y, 1).otherwise(0)) / totals[y]).alias(f"share{y}") for y in (0, 1)])
    n = n.where((F.col("share0") >= COMMON_SHARE) & (F.col("share1") >= COMMON_SHARE)).where(F.abs(F.log(F.col("share1") / F.col("share0"))) < COMMON_RATIO)
    found = [r.word for r in n.orderBy(F.desc(F.col("share0") + F.col("share1")), "word").limit(COMMON_WORDS).collect() if r.word not in GROUPS]
    return by_term(found[i : i + COMMON_KIND] for i in range(0, len(found), COMMON_KIND))


def toxicity_model(docs: DataFrame, labels: DataFrame, keep=None, rows: int = TRAIN_ROWS, swap_weight: float = 1.0) -> Model:
    """Fit ``labels.toxic`` on at most ``rows`` labelled texts for which the Column ``keep`` (over labels) holds.

    No such texts, or only one label among them, give a model that scores every text alike. ``swap_weight`` 0 fits without
    counterfactuals.
    """
    configure(docs.sparkSession)
    sampled = sample(docs, labels, "toxic", F.lit(True) if keep is None else keep, rows)
    common = common_kinds(sampled) if swap_weight else {}
    got = vectors(sampled, TOXICITY, (lambda t: swaps(t, common)) if swap_weight else None)
    return fit(TOXICITY, got, alpha=0.3, l1=1.5, l2=0.1, epochs=4, swap_weight=swap_weight)


def score_toxicity(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """One row per document: ``keep`` and ``score`` (0 to 1, higher is more toxic), as ``score`` says."""
    return score(docs, model, keep)
