"""What fields mean, which expressions over them make sense, and seeded samplers that stay within that."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

from quillon.functions import masks
from quillon.plans.templates import BEHAVIOUR, MODE_FIELDS, MODES, TREE_UNARY, BehaviourGene, Condition, Slot, StructuredGene, Tree, check_behaviour

# Units, groups and families that may be combined.
SINGLE_UNITS = {"ratio", "rate", "growth", "score", "turnover", "yield"}
RATIO_UNITS = {("currency", "currency"), ("ratio", "ratio"), ("rate", "rate"), ("growth", "growth")}
RATIO_GROUPS = {
    ("profit", "market_value"), ("cashflow", "market_value"), ("revenue", "market_value"), ("equity", "market_value"), ("asset", "market_value"), ("profit", "revenue"),
    ("cashflow", "revenue"), ("expense", "revenue"), ("debt", "asset"), ("cash", "asset"), ("cash", "debt"), ("working_capital", "asset"), ("working_capital", "revenue"),
    ("revenue", "asset"), ("profit", "asset"), ("profit", "equity"), ("cashflow", "debt"), ("equity", "asset"),
}
STYLE_FAMILIES = [{"quality", "valuation"}, {"profitability", "valuation"}, {"growth", "valuation"}, {"analyst", "valuation"}, {"quality", "leverage"}, {"quality", "liquidity"}, {"cashflow", "profitability"}, {"efficiency", "profitability"}]
ACCOUNTING = ("current", "diff_2q", "diff_1y")
# Kinds of fields in trees, by data family, and binary operators allowed across kinds (both ways).
KIND_FAMILY = {
    "fund_growth": "fundamental", "fund_quality": "fundamental", "fund_value": "fundamental", "pv_momentum": "price_volume", "pv_volume": "price_volume", "pv_volatility": "price_volume",
    "pv_crowding": "price_volume", "pv_panic": "price_volume", "pv_general": "price_volume", "mf_large": "moneyflow", "mf_small": "moneyflow", "mf_active": "moneyflow", "mf_general": "moneyflow",
    "ob_spread": "orderbook", "ob_depth": "orderbook", "ob_pressure": "orderbook", "control": "control",
}
ACROSS_KINDS = {
    ("fund_growth", "fund_quality"): ("mean", "diff", "residual"),
    ("fund_growth", "fund_value"): ("mean", "diff", "interaction", "residual"),
    ("fund_quality", "fund_value"): ("mean", "diff", "residual"),
    ("pv_momentum", "pv_volume"): ("mean", "diff"),
    ("pv_momentum", "pv_volatility"): ("residual",),
    ("pv_momentum", "pv_crowding"): ("interaction", "residual"),
    ("pv_momentum", "pv_panic"): ("diff", "interaction"),
    ("pv_volume", "pv_crowding"): ("mean", "interaction"),
    ("pv_volume", "pv_volatility"): ("residual",),
    ("pv_crowding", "pv_panic"): ("mean", "interaction"),
    ("mf_large", "mf_small"): ("mean", "diff"),
    ("mf_large", "mf_active"): ("mean", "interaction"),
    ("mf_small", "mf_active"): ("mean", "diff"),
    ("ob_pressure", "ob_spread"): ("residual",),
    ("ob_pressure", "ob_depth"): ("mean", "interaction"),
    ("ob_spread", "ob_depth"): ("mean", "diff"),
}
#: Slots that a data family's fields may fill, by what the slot's name speaks of.
SLOT_FAMILIES = {
    "fundamental": ("fund", "profit", "growth", "cashflow", "quality", "cost"),
    "price_volume": ("price", "momentum", "drawdown", "attention", "crowding", "turnover", "close"),
    "moneyflow": ("flow", "retail", "large", "sell", "crowding", "support"),
    "orderbook": ("orderbook", "liquidity", "close", "sell"),
}


@dataclass(frozen=True)
class FieldRule:
    """A field's meaning: unit, group of addable amounts, family, kind in trees, direction, and transforms it allows."""

    unit: str = "ratio"
    group: str = "unknown"
    family: str = "unknown"
    kind: str = "control"
    direction: int = 1
    signal: bool = True
    denominator: bool = True
    current: bool = True
    log: bool = False
    diff: bool = False
    pct: bool = False
    industry: bool = True

    @property
    def transforms(self) -> list[str]:
        out = (["current", "rank_pct", "zscore"] + ["ind_rank_pct", "ind_zscore"] * self.industry) * self.current
        return out + ["log"] * (self.log and self.current) + ["diff_2q", "diff_1y"] * self.diff + ["pct_2q", "pct_1y"] * self.pct


Term = tuple[str, str]


def _alike(terms: Sequence[Term], rules: Mapping[str, FieldRule]) -> str | None:
    """Terms that may be added: distinct, one accounting transform, one unit, one group."""
    if len(set(terms)) < len(terms):
        return "terms must be distinct"
    if len({t for _, t in terms}) > 1 or terms[0][1] not in ACCOUNTING:
        return "terms need one accounting transform"
    if len({(rules[f].unit, rules[f].group) for f, _ in terms}) > 1:
        return "terms need one unit and group"
    return None


def _ratio(a: Term, b: Term, rules: Mapping[str, FieldRule], whole: bool = True) -> str | None:
    if whole and (a == b or a[1] != b[1] or a[1] not in ACCOUNTING):
        return "a ratio needs two terms of one accounting transform"
    x, y = rules[a[0]], rules[b[0]]
    if (x.unit, y.unit) not in RATIO_UNITS or (x.group, y.group) not in RATIO_GROUPS:
        return f"{x.group} / {y.group} isn't a known ratio"
    return None


def check_structured(g: StructuredGene, rules: Mapping[str, FieldRule]) -> list[str]:
    """What is wrong with a structured gene; empty if nothing is."""
    if g.mode not in MODE_FIELDS:
        return [f"unknown mode {g.mode!r}"]
    n = MODE_FIELDS[g.mode]
    if len(g.fields) < n or {g.left_op, g.right_op} - {"+", "-"}:
        return ["too few fields or an unknown operator"]
    terms = list(zip(g.fields[:n], (g.transforms or ("current",) * n)[:n], strict=True))
    roles = {"ratio": "yx", "spread": "yxyx", "pair_ratio": "yyxx", "style_composite": "yx", "single": "y"}.get(g.mode, "*" * n)
    wrong = []
    for (f, t), role in zip(terms, roles, strict=True):
        if f not in rules:
            wrong.append(f"unknown field {f!r}")
        elif t not in rules[f].transforms:
            wrong.append(f"{f} doesn't allow {t}")
        elif role == "y" and not rules[f].signal or role == "x" and not rules[f].denominator:
            wrong.append(f"{f} can't stand there")
    if wrong:
        return wrong
    why: str | None = None
    if g.mode == "single":
        r = rules[terms[0][0]]
        why = None if r.unit in SINGLE_UNITS or r.family == "valuation" else "not a metric by itself"
    elif g.mode == "ratio":
        why = _ratio(*terms, rules)
    elif g.mode == "pair_ratio":
        why = _alike(terms[:2], rules) or _alike(terms[2:], rules) or _ratio(terms[0], terms[2], rules, whole=False)
        minus = [terms[0][0]] * (g.left_op == "-") + [terms[2][0]] * (g.right_op == "-")
        why = why or next((f"{f} can't be subtracted" for f in minus if rules[f].group in ("score", "unknown")), None)
    elif g.mode == "spread":
        why = _ratio(*terms[:2], rules) or _ratio(*terms[2:], rules) or ("both ratios are the same" if terms[:2] == terms[2:] else None)
    elif g.mode == "style_composite":
        a, b = (rules[f] for f, _ in terms)
        fine = terms[0][0] != terms[1][0] and {t for _, t in terms} == {"current"} and {a.family, b.family} in STYLE_FAMILIES and not a.unit == b.unit == "currency"
        why = None if fine else "not a known pair of styles"
    elif terms[0] in terms[1:]:
        why = "the target can't be a control"
    elif n > 2:
        why = _alike(terms[1:], rules)
    return [why] if why else []


def allowed_binary(a: str, b: str) -> set[str]:
    """Binary tree operators between two kinds: all within one, the listed ones across."""
    if a == b:
        return {"mean", "diff", "interaction", "residual"}
    return set(ACROSS_KINDS.get((a, b)) or ACROSS_KINDS.get((b, a)) or ())


def check_tree(t: Tree, rules: Mapping[str, FieldRule], max_depth: int = 3) -> list[str]:
    """What is wrong with a slot's tree: unknown or repeated leaves, more than one data family, operators its kinds don't allow, depth."""
    leaves = t.leaves
    wrong = [f"unknown field {x!r}" for x in leaves if x not in rules]
    if wrong:
        return wrong
    if len(set(leaves)) < len(leaves):
        wrong.append("a field stands twice")
    if len({KIND_FAMILY.get(rules[x].kind) for x in leaves}) > 1:
        wrong.append("more than one data family")
    if t.depth > max_depth:
        wrong.append(f"deeper than {max_depth}")
    for n in _walk(t):
        if len(n.args) == 2 and n.op not in allowed_binary(*(rules[a.leaves[0]].kind for a in n.args)):
            wrong.append(f"{n.op} isn't allowed there")
        elif len(n.args) == 1 and n.op not in TREE_UNARY:
            wrong.append(f"unknown operator {n.op!r}")
    return wrong


def _walk(t: Tree) -> Iterator[Tree]:
    yield t
    for a in t.args:
        yield from _walk(a)


def slot_fields(rules: Mapping[str, FieldRule], slot: str) -> list[str]:
    """Fields whose data family speaks of what the slot is about; all signals where none does."""
    fits = [f for f, r in rules.items() if any(w in slot for w in SLOT_FAMILIES.get(KIND_FAMILY.get(r.kind, "control"), ()))]
    return fits or [f for f, r in rules.items() if r.kind != "control"] or list(rules)


def condition_fields(rules: Mapping[str, FieldRule]) -> list[str]:
    """Fields that may gate a gene: all but plain controls, if there are others."""
    return [f for f, r in rules.items() if r.kind != "control"] or list(rules)


@dataclass
class Sampler:
    """Seeded structured and behaviour genes over fields with rules; whatever it returns passes its check.

    ``optional``, ``condition``: chances of optional slots and of conditions. ``terminal``, ``unary``: chances that a tree
    ends, or has one child, ``slot_depth`` and ``nodes`` its limits. ``weights``: how often modes are drawn, others never.
    """

    rules: Mapping[str, FieldRule]
    seed: int = 1
    optional: float = 0.6
    condition: float = 0.45
    thresholds: tuple[float, ...] = (0.55, 0.6, 0.7, 0.8)
    tries: int = 4000
    terminal: float = 0.58
    unary: float = 0.2
    slot_depth: int = 3
    nodes: int = 32
    fixed: bool = True
    weights: Mapping[str, float] | None = None

    def __post_init__(self) -> None:
        self.rng = random.Random(self.seed)
        chances = (self.optional, self.condition, self.terminal, self.unary)
        if not all(0 <= c <= 1 for c in chances) or self.slot_depth < 1 or self.nodes < 1 or not self.thresholds:
            raise ValueError("chances are between 0 and 1, depth and nodes are positive, thresholds aren't empty")
        unknown = set(self.weights or ()) - {*MODES, *MODE_FIELDS}
        if unknown or self.weights is not None and (min(self.weights.values(), default=0) < 0 or not sum(self.weights.values())):
            raise ValueError(f"weights are of known modes, not negative and not all zero: {sorted(unknown)}")

    def _mode(self, modes: Sequence[str]) -> str:
        return self.rng.choice(list(modes)) if self.weights is None else self.rng.choices(list(modes), [self.weights.get(m, 0.0) for m in modes])[0]

    def _first(self, make: Callable[[], object], ok: Callable[[object], bool], other: object = None) -> object:
        return next((g for g in (make() for _ in range(self.tries)) if ok(g)), other)

    def structured(self, mode: str | None = None) -> StructuredGene:
        """A legal gene of a mode, or of any; ValueError where the rules allow none."""
        r, names = self.rng, list(self.rules)

        def make() -> StructuredGene:
            m = mode or self._mode(list(MODE_FIELDS))
            # Terms that are added are drawn from one group.
            alike = {"pair_ratio": {1: 0, 3: 2}, "resi_pair": {2: 1}, "multi_resi": {2: 1, 3: 1}}.get(m, {})
            fields: list[str] = []
            for k in range(MODE_FIELDS[m]):
                like = self.rules[fields[alike[k]]] if k in alike else None
                fields.append(r.choice([f for f in names if like is None or (self.rules[f].unit, self.rules[f].group) == (like.unit, like.group)]))
            shared = r.choice(ACCOUNTING)
            picks = tuple("current" if m == "style_composite" else shared if m not in ("single", "resi") else r.choice(self.rules[f].transforms or ["current"]) for f in fields)
            return StructuredGene(m, tuple(fields), picks, r.choice("+-"), r.choice("+-"))

        g = self._first(make, lambda g: not check_structured(g, self.rules))
        if g is None:
            raise ValueError("the rules allow no such gene")
        return g

    def mutate(self, g: StructuredGene) -> StructuredGene:
        """One field, transform or operator changed; the gene itself where no such change is legal."""

        def make() -> StructuredGene:
            k = self.rng.randrange(len(g.fields))
            put = lambda xs, v: (*xs[:k], v, *xs[k + 1 :])
            return self.rng.choice([
                replace(g, fields=put(g.fields, self.rng.choice(list(self.rules)))),
                replace(g, transforms=put(g.transforms, self.rng.choice(ACCOUNTING))),
                replace(g, left_op=self.rng.choice("+-")),
            ])

        return self._first(make, lambda x: x != g and not check_structured(x, self.rules), g)

    def cross(self, a: StructuredGene, b: StructuredGene) -> StructuredGene:
        """Fields and transforms of two genes of one mode mixed; the first where they can't be."""
        if a.mode != b.mode:
            return a

        def make() -> StructuredGene:
            side = [self.rng.random() < 0.5 for _ in a.fields]
            mixed = [tuple(x if s else y for s, x, y in zip(side, p, q, strict=True)) for p, q in ((a.fields, b.fields), (a.transforms, b.transforms))]
            return replace(a, fields=mixed[0], transforms=mixed[1])

        return self._first(make, lambda g: not check_structured(g, self.rules), a)

    def tree(self, fields: Sequence[str], depth: int | None = None) -> Tree:
        """A legal slot tree over some of the fields."""
        depth = depth or self.slot_depth

        def make(d: int) -> Tree:
            r = self.rng
            if d <= 1 or r.random() < self.terminal:
                return Tree("", leaf=r.choice(list(fields)))
            if r.random() < self.unary:
                return Tree(r.choice(list(TREE_UNARY)), (make(d - 1),))
            return Tree(r.choice(["mean", "diff", "interaction", "residual"]), (make(d - 1), make(d - 1)))

        return self._first(lambda: make(depth), lambda t: t.size <= self.nodes and not check_tree(t, self.rules, depth), Tree("", leaf=fields[0]))

    def behaviour(self, mode: str | None = None, trees: bool = False) -> BehaviourGene:
        """A gene of a behaviour mode: required slots, optional ones by chance, perhaps a condition."""
        r = self.rng
        m = mode or self._mode(list(MODES))
        slots = {}
        for s in MODES[m].slots:
            if not s.endswith("?") or r.random() < self.optional:
                names = slot_fields(self.rules, s.rstrip("?"))
                f = r.choice(names)
                slots[s.rstrip("?")] = Slot(self.tree(names)) if trees else Slot(f, r.choice(list(BEHAVIOUR)), self.rules[f].direction)
        gates = condition_fields(self.rules)
        held = tuple(Condition(r.choice(gates), r.choice(list(masks.CONDITIONS)), r.choice(self.thresholds)) for _ in range(MODES[m].conditions) if r.random() < self.condition)
        g = BehaviourGene(m, r.choice(MODES[m].combiners), slots, held, self.fixed)
        assert not check_behaviour(g)
        return g

    def mutate_behaviour(self, g: BehaviourGene, trees: bool = False) -> BehaviourGene:
        """One slot, the combiner or the conditions drawn anew; the gene itself where no other is legal."""

        def make() -> BehaviourGene:
            new, part = self.behaviour(g.mode, trees), self.rng.choice(["slot", "slot", "combiner", "conditions"])
            if part == "slot":
                name = self.rng.choice(list(new.slots))
                return replace(g, slots={**g.slots, name: new.slots[name]})
            return replace(g, **{part: getattr(new, part)})

        return self._first(make, lambda x: x.key != g.key and not check_behaviour(x), g)

    def cross_behaviour(self, a: BehaviourGene, b: BehaviourGene) -> BehaviourGene:
        """Slots, combiner and conditions of two genes of one mode mixed; the first where they can't be."""
        if a.mode != b.mode:
            return a
        pick = lambda x, y: self.rng.choice([x, y])
        slots = {k: pick(a.slots.get(k), b.slots.get(k)) for k in dict.fromkeys([*a.slots, *b.slots])}
        g = BehaviourGene(a.mode, pick(a.combiner, b.combiner), {k: s for k, s in slots.items() if s}, pick(a.conditions, b.conditions), a.fixed)
        return a if check_behaviour(g) else g


#: Parts of names that tell a field's meaning, first match wins.
NAME_HINTS = (
    (("yield", "_to_price", "book_to", "ep_", "bm_", "cfp", "sp_"), {"unit": "yield", "family": "valuation", "kind": "fund_value"}),
    (("growth", "yoy", "qoq", "accel"), {"unit": "growth", "family": "growth", "kind": "fund_growth"}),
    (("roe", "roa", "margin", "quality", "cashflow"), {"unit": "ratio", "family": "quality", "kind": "fund_quality"}),
    (("turnover", "volume", "amount"), {"unit": "turnover", "family": "liquidity", "kind": "pv_volume"}),
    (("ret_", "momentum"), {"unit": "rate", "family": "momentum", "kind": "pv_momentum"}),
    (("vol", "std", "atr"), {"unit": "rate", "family": "risk", "kind": "pv_volatility", "direction": -1}),
    (("spread",), {"unit": "ratio", "family": "orderbook", "kind": "ob_spread", "direction": -1}),
    (("imbalance", "pressure", "intent"), {"unit": "ratio", "family": "orderbook", "kind": "ob_pressure"}),
    (("_lg", "_elg", "large"), {"unit": "ratio", "family": "moneyflow", "kind": "mf_large"}),
    (("_sm", "small", "retail"), {"unit": "ratio", "family": "moneyflow", "kind": "mf_small", "direction": -1}),
    (("profit", "income"), {"unit": "currency", "group": "profit", "family": "profitability", "log": True, "diff": True, "pct": True}),
    (("revenue", "sales"), {"unit": "currency", "group": "revenue", "family": "profitability", "log": True, "diff": True, "pct": True}),
    (("market_cap", "enterprise_value"), {"unit": "currency", "group": "market_value", "family": "size", "log": True}),
    (("asset",), {"unit": "currency", "group": "asset", "family": "leverage", "log": True, "diff": True}),
    (("equity",), {"unit": "currency", "group": "equity", "family": "leverage", "log": True, "diff": True}),
    (("debt", "liabil"), {"unit": "currency", "group": "debt", "family": "leverage", "log": True, "diff": True, "direction": -1}),
    (("score", "rating"), {"unit": "score", "group": "score", "family": "analyst"}),
)


def infer_rules(names: Sequence[str]) -> dict[str, FieldRule]:
    """Rules guessed from field names; a name without any hint is a plain control."""
    return {n: FieldRule(**next((meaning for hints, meaning in NAME_HINTS if any(h in n.lower() for h in hints)), {})) for n in names}
