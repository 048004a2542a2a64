"""A seeded search over any kind of candidate: programs, structured, behaviour and tree genes. Candidates live on the driver;
each batch of them is scored as columns of one plan."""

from __future__ import annotations

import random
from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.operators import metrics as mt
from quillon.operators import selection
from quillon.operators.scorer import OBJECTIVES, FactorScore, Scorer, ScorerConfig
from quillon.plans import rules
from quillon.plans.layers import DATE, Layers, SparkPanel
from quillon.plans.storage import without_shuffles
from quillon.plans.templates import Tree, compile_behaviour, compile_structured


@dataclass(frozen=True)
class Score:
    """Mean rank IC, its ratio and share of days of the direction's sign, mean coverage; nothing known scores zero."""

    ic: float = 0.0
    ir: float = 0.0
    win: float = 0.0
    coverage: float = 0.0
    direction: int = 1
    days: int = 0
    error: str = ""


@dataclass(frozen=True)
class Criteria:
    """What a candidate must reach on dates it wasn't chosen on."""

    least_ic: float = 0.02
    least_win: float = 0.55
    least_coverage: float = 0.3

    def passed(self, s: Score) -> bool:
        return not s.error and s.ic * s.direction >= self.least_ic and s.win >= self.least_win and s.coverage >= self.least_coverage


@dataclass(frozen=True)
class Kind:
    """How candidates are made, bred, told apart, priced and turned into a column."""

    random: Callable[[], Any]
    offspring: Callable[[Sequence[Any]], Any]
    compile: Callable[[Layers, Any], str]
    key: Callable[[Any], Hashable]
    cost: Callable[[Any], float] = lambda g: 0.0


@dataclass(frozen=True)
class Sizes:
    """Population, rounds, and programs in a plan. ``size_weight`` charges objectives for cost, as for trees."""

    population: int = 80
    generations: int = 3
    batch: int = 16
    least_coverage: float = 0.3
    size_weight: float = 0.0


@dataclass(frozen=True)
class Evolved:
    candidate: Any
    score: Score | FactorScore
    front: int


def score_batch(panel: SparkPanel, kind: Kind, batch: Sequence[Any], label: str = "label", least: int = 3, where: str = "TRUE", directions: Sequence[int] | None = None) -> list[Score]:
    """Scores of candidates over the dates that ``where`` keeps; windows still see the dates before them.

    ``directions`` are those learnt elsewhere; without them the sign of the mean is taken. A candidate that can't be
    planned or run gets an empty score with its error, and doesn't take others down with it.
    """
    if not batch:
        return []
    p, cols, out = panel.anew(), {}, {}
    for i, g in enumerate(batch):
        try:
            x = kind.compile(p, g)
            cols[i] = (x, *[mt.cs.average_rank(p, c) for c in mt.joint(p, *mt.masked(p, x, label))])
        except (ValueError, KeyError) as e:
            out[i] = Score(error=f"{type(e).__name__}: {e}")
    row = None
    if cols:
        daily = [e for i, (x, a, b) in cols.items() for e in (F.expr(mt.correlation(a, b, least)).alias(f"ic{i}"), F.expr(f"count({x}) / nullif(count(CASE WHEN tradeable THEN 1 END), 0)").alias(f"cov{i}"))]
        total = [e for i in cols for e in (
            F.avg(f"ic{i}").alias(f"m{i}"), F.stddev_samp(f"ic{i}").alias(f"s{i}"), F.avg(f"cov{i}").alias(f"c{i}"), F.count(f"ic{i}").alias(f"n{i}"),
            F.count_if(F.col(f"ic{i}") > 0).alias(f"u{i}"), F.count_if(F.col(f"ic{i}") < 0).alias(f"d{i}"),
        )]
        try:
            with without_shuffles(p.spark):
                row = p.frame(list(dict.fromkeys(c for t in cols.values() for c in t)), p.named([where, "tradeable"]), where).groupBy(DATE).agg(*daily).agg(*total).first()
        except PySparkException as e:
            if len(batch) > 1:
                h, d = len(batch) // 2, directions or [None] * len(batch)
                halves = [(batch[:h], d[:h]), (batch[h:], d[h:])]
                return [s for part, signs in halves for s in score_batch(panel, kind, part, label, least, where, signs if directions else None)]
            out |= {i: Score(error=type(e).__name__) for i in cols}
    for i in cols if row else ():
        m, s, c, n, up, down = (row[f"{k}{i}"] or 0 for k in "mscnud")
        sign = directions[i] if directions else 1 if m >= 0 else -1
        out[i] = Score(float(m), sign * m / s if s > 1e-12 else 0.0, (up if sign > 0 else down) / n if n else 0.0, float(c), sign, n)
    return [out[i] for i in range(len(batch))]


def score_all(panel: SparkPanel, kind: Kind, candidates: Sequence[Any], size: int = 16, label: str = "label", where: str = "TRUE", directions: Sequence[int] | None = None) -> list[Score]:
    """Scores of any number of candidates, a plan per ``size`` of them."""
    at = range(0, len(candidates), size)
    return [s for i in at for s in score_batch(panel, kind, candidates[i : i + size], label, where=where, directions=directions[i : i + size] if directions else None)]


def evolve(panel: SparkPanel, kind: Kind, sizes: Sizes = Sizes(), label: str = "label", where: str = "TRUE", objectives: str | None = None, config: ScorerConfig = ScorerConfig()) -> list[Evolved]:
    """Generations of candidates by front, best first. Each key is scored once; what lacks coverage never stays before what has it.

    Without ``objectives`` the ratio and size of the mean rank IC are maximised; a name of ``scorer.OBJECTIVES`` has all
    metrics of ``config`` scored and maximises those.
    """
    known: dict[Hashable, Score | FactorScore] = {}
    scorer = Scorer(panel, label, config, where)

    def score(new: Sequence[Any]) -> list:
        if objectives is None:
            return score_all(panel, kind, new, sizes.batch, label, where)
        return scorer.score_columns([lambda p, g=g: kind.compile(p, g) for g in new], max(1, sizes.batch // 4))

    def evaluate(pool: Sequence[Any]) -> list[Any]:
        pool = list({kind.key(g): g for g in pool}.values())
        new = [g for g in pool if kind.key(g) not in known]
        known.update(zip(map(kind.key, new), score(new), strict=True))
        return pool

    def goals(pool: Sequence[Any]) -> list[list[float]]:
        found = [known[kind.key(g)] for g in pool]
        width = len(OBJECTIVES[objectives]) if objectives else 2
        goal = lambda s: s.objectives(objectives) if objectives else (s.ir, abs(s.ic))
        raw = [goal(s) if s.coverage >= sizes.least_coverage and not s.error else (float("nan"),) * width for s in found]
        return selection.penalised(raw, [kind.cost(g) for g in pool], sizes.size_weight)

    alive = evaluate([kind.random() for _ in range(sizes.population)])
    for _ in range(sizes.generations):
        pool = evaluate([*alive, *[kind.offspring(alive) for _ in range(sizes.population)]])
        alive = [pool[i] for i in selection.elites(goals(pool), sizes.population, [kind.cost(g) for g in pool])]
    return [Evolved(alive[r.index], known[kind.key(alive[r.index])], r.front) for r in selection.rank(goals(alive))]


def validate(panel: SparkPanel, kind: Kind, found: Sequence[Evolved], criteria: Criteria = Criteria(), label: str = "label", where: str = "TRUE", size: int = 16) -> list[tuple[Evolved, bool]]:
    """The same candidates on other dates, in the direction they were found with, and whether each passes; ranked anew."""
    scores = score_all(panel, kind, [e.candidate for e in found], size, label, where, [e.score.direction for e in found])
    order = selection.rank([(s.ir, s.ic * s.direction) for s in scores])
    return [(Evolved(found[r.index].candidate, scores[r.index], r.front), criteria.passed(scores[r.index])) for r in order]


def _breeder(rng: random.Random, cross: Callable, mutate: Callable, p_cross: float, p_mutate: float) -> Callable[[Sequence[Any]], Any]:
    def child(parents: Sequence[Any]) -> Any:
        a, b = rng.choice(list(parents)), rng.choice(list(parents))
        g = cross(a, b) if rng.random() < p_cross else a
        return mutate(g) if rng.random() < p_mutate else g

    return child


def structured_kind(sampler: rules.Sampler, industry: bool = False, size: bool = False, p_cross: float = 0.85, p_mutate: float = 0.25) -> Kind:
    """Structured genes, demeaned by industry or freed of size where asked."""
    add = lambda g: replace(g, industry=industry, size=size)
    return Kind(lambda: add(sampler.structured()), _breeder(sampler.rng, sampler.cross, sampler.mutate, p_cross, p_mutate), compile_structured, lambda g: g.key)


def behaviour_kind(sampler: rules.Sampler, trees: bool = False, steps: tuple[str, ...] = (), fill: str = "nan", p_cross: float = 0.85, p_mutate: float = 0.25) -> Kind:
    """Behaviour genes with a field, or with ``trees`` a typed tree, in each slot; cost is the size of the trees."""
    mutate = lambda g: sampler.mutate_behaviour(g, trees)
    cost = lambda g: float(sum(s.source.size for s in g.slots.values() if isinstance(s.source, Tree)))
    breed = _breeder(sampler.rng, sampler.cross_behaviour, mutate, p_cross, p_mutate)
    return Kind(lambda: sampler.behaviour(trees=trees), breed, lambda p, g: compile_behaviour(p, g, steps, fill), lambda g: g.key, cost)
