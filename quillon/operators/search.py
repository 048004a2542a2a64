"""Seeded evolutionary search over programs. Trees are made on the driver; a generation is scored by one plan per batch."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field

from quillon.functions.registry import operators
from quillon.operators.evolve import Kind, Sizes, evolve
from quillon.plans.layers import SparkPanel
from quillon.plans.program import Node, Program, call, check, compile_program, const
from quillon.plans.program import field as leaf


@dataclass(frozen=True)
class SearchConfig:
    """Sizes, chances and limits of a search."""

    population: int = 80
    generations: int = 3
    crossover: float = 0.85
    mutation: float = 0.25
    terminal: float = 0.2
    constant: float = 0.05
    gate: float = 0.15
    max_depth: int = 5
    max_size: int = 64
    min_coverage: float = 0.3
    batch: int = 16
    windows: tuple[int, ...] = ()
    seed: int = 1


@dataclass(frozen=True)
class Found:
    """A scored program."""

    program: str
    expression: str
    ic: float
    ir: float
    coverage: float
    front: int = 0


@dataclass
class Generator:
    """Random, mutated and crossed programs that pass ``check``."""

    fields: Sequence[str]
    config: SearchConfig
    rng: random.Random = field(init=False)

    def __post_init__(self) -> None:
        self.rng = random.Random(self.config.seed)
        def usable(o) -> bool:
            w = next((int(x) for x in o.name.split("_") if x.isdigit()), None)
            return o.category != "time_series" or not self.config.windows or w in self.config.windows

        self.numeric = [o for o in operators(output="numeric") if o.category != "gate" and usable(o)]
        self.masks, self.gates = operators(output="mask"), operators("gate")

    def node(self, depth: int) -> Node:
        r, c = self.rng, self.config
        if depth <= 1 or r.random() < c.terminal:
            return const(round(r.uniform(-2, 2), 3)) if r.random() < c.constant else leaf(r.choice(list(self.fields)))
        if depth > 2 and r.random() < c.gate:
            return call(r.choice(self.gates).name, self.node(depth - 1), call(r.choice(self.masks).name, self.node(depth - 2)))
        op = r.choice(self.numeric)
        return call(op.name, *[self.node(depth - 1) for _ in range(op.arity)])

    def ok(self, p: Program) -> bool:
        return bool(p.root.fields) and not check(p, self.fields, self.config.max_depth, self.config.max_size)

    def random(self) -> Program:
        while not self.ok(p := Program(self.node(self.config.max_depth))):
            pass
        return p

    def _swap(self, p: Program, other: Program | None) -> Program:
        spots = [(i, n) for i, n in enumerate(p.root.walk()) if n.output == "numeric"]
        i, n = self.rng.choice(spots)
        new = self.rng.choice([m for m in other.root.walk() if m.output == "numeric"]) if other else self.node(max(1, min(3, n.depth + 1)))
        return Program(p.root.with_at(i, new))

    def mutate(self, p: Program, tries: int = 10) -> Program:
        return next((q for q in (self._swap(p, None) for _ in range(tries)) if self.ok(q)), p)

    def cross(self, p: Program, q: Program, tries: int = 10) -> Program:
        return next((x for x in (self._swap(p, q) for _ in range(tries)) if self.ok(x)), p)

    def offspring(self, parents: Sequence[Program]) -> Program:
        a, b = self.rng.choice(list(parents)), self.rng.choice(list(parents))
        child = self.cross(a, b) if self.rng.random() < self.config.crossover else a
        return self.mutate(child) if self.rng.random() < self.config.mutation else child


def program_kind(g: Generator) -> Kind:
    """Programs as candidates of a search; of equals the cheaper stays."""
    return Kind(g.random, g.offspring, compile_program, lambda p: p.key, lambda p: p.root.cost)


def search(panel: SparkPanel, fields: Sequence[str], config: SearchConfig = SearchConfig(), label: str = "label", where: str = "TRUE") -> list[Found]:
    """Generations of scored programs over the dates ``where`` keeps, best front first."""
    sizes = Sizes(config.population, config.generations, config.batch, config.min_coverage)
    found = evolve(panel, program_kind(Generator(fields, config)), sizes, label, where)
    return [Found(e.candidate.to_json(), str(e.candidate), e.score.ic, e.score.ir, e.score.coverage, e.front) for e in found]
