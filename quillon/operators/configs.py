"""Settings of the searches by kind, checked when made, and a run of any of them on a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quillon.operators import evolve as ev
from quillon.operators.metrics import PROGRAM, STRUCTURED
from quillon.operators.scorer import OBJECTIVES, ScorerConfig
from quillon.operators.search import Generator, SearchConfig, program_kind
from quillon.plans.layers import SparkPanel
from quillon.plans.rules import FieldRule, Sampler
from quillon.plans.templates import neutralise_industry

KINDS = ("structured", "behaviour", "tree", "program")


@dataclass(frozen=True)
class SearchSettings:
    """What a search is made of. ``industry`` tells the universe: factors of several industries are freed of them. ``objectives`` None maximises ratio and size of the mean rank IC alone."""

    kind: str
    population: int = 80
    generations: int = 3
    crossover: float = 0.85
    mutation: float = 0.25
    seed: int = 1
    ndcg_k: int | None = None
    ndcg_fraction: float = 0.1
    least_coverage: float = 0.3
    weights: Mapping[str, float] | None = None
    objectives: str | None = None
    industry: str | Sequence[str] | None = None
    size: bool = False
    size_weight: float = 0.0
    batch: int = 16
    sampler: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        wrong = [
            why
            for bad, why in (
                (self.kind not in KINDS, f"a kind is one of {', '.join(KINDS)}"),
                (self.population <= 0 or self.generations < 0 or self.batch <= 0, "population and batch are positive, generations not negative"),
                (not all(0 <= x <= 1 for x in (self.crossover, self.mutation, self.least_coverage)), "chances and coverage are between 0 and 1"),
                (not 0 < self.ndcg_fraction <= 1 or self.ndcg_k is not None and self.ndcg_k <= 0, "ndcg takes a positive k or a fraction in (0, 1]"),
                (self.objectives is not None and self.objectives not in OBJECTIVES, f"objectives are {', '.join(OBJECTIVES)}"),
                (self.size_weight < 0, "a charge for size isn't negative"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))

    @property
    def steps(self) -> tuple[str, ...]:
        return ("industry",) * neutralise_industry(self.industry) + ("size",) * self.size

    def scorer(self) -> ScorerConfig:
        rules = PROGRAM if self.kind == "program" else STRUCTURED
        return ScorerConfig(rules, self.ndcg_k, self.ndcg_fraction, own_bins=self.kind != "program", direction=1 if self.kind in ("behaviour", "tree") and self.sampler.get("fixed", True) else None, steps=("size", "industry"))


# The settings that searches of each kind start from, and what their candidates must reach on later dates.
DEFAULTS = {
    "structured": SearchSettings("structured", objectives="structured"),
    "behaviour": SearchSettings("behaviour", seed=20260529, objectives="behaviour_neutral", sampler={"optional": 0.6, "condition": 0.45, "thresholds": (0.55, 0.6, 0.7, 0.8)}),
    "tree": SearchSettings("tree", seed=20260529, objectives="behaviour", size_weight=0.001, sampler={"optional": 0.45, "condition": 0.35, "thresholds": (0.55, 0.6, 0.7, 0.8), "terminal": 0.58, "unary": 0.2, "slot_depth": 3, "nodes": 32}),
    "program": SearchSettings("program", objectives="structured", sampler={"max_depth": 5, "max_size": 64, "constant": 0.05, "terminal": 0.2, "gate": 0.15}),
}
CRITERIA = {"structured": ev.Criteria(0.02, 0.55, 0.3), "behaviour": ev.Criteria(0.02, 0.55, 0.3), "tree": ev.Criteria(0.02, 0.55, 0.3), "program": ev.Criteria(0.02, 0.55, 0.3)}


def kind_of(s: SearchSettings, fields: Mapping[str, FieldRule]) -> ev.Kind:
    """The candidates that settings ask for, over fields with rules."""
    if s.kind == "program":
        return program_kind(Generator(list(fields), SearchConfig(crossover=s.crossover, mutation=s.mutation, seed=s.seed, **s.sampler)))
    sampler = Sampler(fields, s.seed, weights=s.weights, **s.sampler)
    if s.kind == "structured":
        return ev.structured_kind(sampler, "industry" in s.steps, s.size, s.crossover, s.mutation)
    return ev.behaviour_kind(sampler, s.kind == "tree", s.steps, p_cross=s.crossover, p_mutate=s.mutation)


def run(panel: SparkPanel, s: SearchSettings, fields: Mapping[str, FieldRule], label: str = "label", train: str = "TRUE", later: str | None = None) -> DataFrame:
    """(candidate, front, objectives' metrics on the dates ``train``, and, with ``later``, their values there and whether they pass)."""
    kind = kind_of(s, fields)
    found = ev.evolve(panel, kind, ev.Sizes(s.population, s.generations, s.batch, s.least_coverage, s.size_weight), label, train, s.objectives, s.scorer())
    names = OBJECTIVES[s.objectives] if s.objectives else ("ir", "ic")
    rows = [[str(e.candidate), e.front, e.score.direction, e.score.ic, e.score.coverage, *[float(getattr(e.score, n)) for n in names]] for e in found]
    schema = "candidate string, front int, direction int, rank_ic double, coverage double, " + ", ".join(f"goal_{n} double" for n in names)
    if later:
        checked = {kind.key(e.candidate): (e.score, ok) for e, ok in ev.validate(panel, kind, found, CRITERIA[s.kind], label, later)}
        for row, e in zip(rows, found, strict=True):
            score, ok = checked[kind.key(e.candidate)]
            row += [score.ic, score.ir, ok]
        schema += ", later_rank_ic double, later_rank_ic_ir double, passed boolean"
    return panel.spark.createDataFrame(rows, schema)
