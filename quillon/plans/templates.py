"""Expression templates: structured genes, behaviour genes and typed slot trees, compiled to layered plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from quillon.functions import cross_section as cs
from quillon.functions import masks
from quillon.functions import pointwise as pw
from quillon.functions import time_series as ts
from quillon.plans.layers import Layers

HALF_YEAR, YEAR = 120, 244

#: Unary transforms of structured genes.
STRUCTURED = {
    "current": lambda p, x: x,
    "log": pw.slog,
    "rank_pct": cs.rank_pct,
    "zscore": lambda p, x: cs.zscore(p, x, flat="zero"),
    "ind_rank_pct": lambda p, x: cs.rank_pct(p, x, "industry"),
    "ind_zscore": lambda p, x: cs.zscore(p, x, "industry"),
    "diff_2q": lambda p, x: ts.ts_delta(p, x, HALF_YEAR),
    "diff_1y": lambda p, x: ts.ts_delta(p, x, YEAR),
    "pct_2q": lambda p, x: ts.pct_change(p, x, HALF_YEAR),
    "pct_1y": lambda p, x: ts.pct_change(p, x, YEAR),
}

#: Unary transforms of behaviour slots; direction multiplies the two directed ones.
BEHAVIOUR = {
    "current": lambda p, x, d: x,
    "rank_pct": lambda p, x, d: cs.centred_rank(p, x),
    "zscore": lambda p, x, d: cs.zscore(p, x, flat="zero"),
    "direction_rank": lambda p, x, d: p.let(f"{d} * {cs.centred_rank(p, x)}"),
    "direction_zscore": lambda p, x, d: p.let(f"{d} * {cs.zscore(p, x, flat='zero')}"),
    "ind_rank_pct": lambda p, x, d: cs.centred_rank(p, x, "industry"),
    "ind_zscore": lambda p, x, d: cs.zscore(p, x, "industry"),
    "ts_zscore_5d": lambda p, x, d: ts.ts_zscore_partial(p, x, 5),
    "ts_zscore_20d": lambda p, x, d: ts.ts_zscore_partial(p, x, 20),
}

#: Unary and binary operators of typed trees.
TREE_UNARY = {
    "rank": cs.centred_rank,
    "zscore": lambda p, x: cs.zscore(p, x, flat="zero"),
    "ind_rank": lambda p, x: cs.centred_rank(p, x, "industry"),
    "ind_zscore": lambda p, x: cs.zscore(p, x, "industry"),
    "ts_zscore_5d": lambda p, x: ts.ts_zscore_partial(p, x, 5),
    "ts_zscore_20d": lambda p, x: ts.ts_zscore_partial(p, x, 20),
    "neg": pw.neg,
    "abs": pw.absolute,
    "clip": pw.clip,
}
TREE_BINARY = {"mean": pw.mean_of_two, "diff": pw.sub, "interaction": pw.mul, "residual": lambda p, y, x: cs.residual(p, y, x, flat="demean")}


@dataclass(frozen=True)
class StructuredGene:
    """A mode over up to four fields a..d with a transform each; the operators join the pairs of ``pair_ratio``."""

    mode: str
    fields: tuple[str, ...]
    transforms: tuple[str, ...] = ()
    left_op: str = "+"
    right_op: str = "+"
    industry: bool = False
    size: bool = False
    directions: tuple[int, int] = (1, 1)

    @property
    def key(self) -> tuple:
        """Equal for genes of one meaning: sums may come in any order."""
        t = self.transforms or ("current",) * len(self.fields)
        x = list(zip(self.fields, t, strict=True))
        tail = (self.industry, self.size)
        if self.mode == "pair_ratio":
            side = lambda a, b, op: (op, *(sorted((a, b)) if op == "+" else (a, b)))
            return self.mode, side(*x[:2], self.left_op), side(*x[2:4], self.right_op), tail
        if self.mode in ("resi_pair", "multi_resi"):
            return self.mode, x[0], tuple(sorted(x[1:])), tail
        if self.mode == "style_composite":
            return self.mode, tuple(sorted(zip(x, self.directions, strict=True))), tail
        return self.mode, tuple(x), tail

    def __str__(self) -> str:
        t = self.transforms or ("current",) * len(self.fields)
        v = [f if k == "current" else f"{k}({f})" for f, k in zip(self.fields, t, strict=True)]
        return {
            "single": "{0}", "ratio": "{0} / {1}", "pair_ratio": f"({{0}} {self.left_op} {{1}}) / ({{2}} {self.right_op} {{3}})", "resi": "residual({0} ~ {1})",
            "resi_pair": "residual({0} ~ {1} + {2})", "multi_resi": "residual({0} ~ {1} + {2} + {3})", "spread": "{0} / {1} - {2} / {3}", "style_composite": "rank({0}) + rank({1})",
        }[self.mode].format(*v)


#: Fields a mode uses.
MODE_FIELDS = {"single": 1, "ratio": 2, "pair_ratio": 4, "resi": 2, "resi_pair": 3, "multi_resi": 4, "spread": 4, "style_composite": 2}


def compile_structured(p: Layers, g: StructuredGene) -> str:
    """Transforms, mode, then industry demeaning, then the residual on size, then the tradeable mask."""
    n = MODE_FIELDS[g.mode]
    v = [STRUCTURED[t](p, f) for f, t in zip(g.fields[:n], g.transforms or ("current",) * n, strict=True)]
    ratio = lambda a, b: pw.divide(p, a, b, pw.STRUCTURED_EPS)
    pair = lambda a, b, op: (pw.add if op == "+" else pw.sub)(p, a, b)
    if g.mode == "single":
        out = v[0]
    elif g.mode == "ratio":
        out = ratio(*v)
    elif g.mode == "pair_ratio":
        out = ratio(pair(v[0], v[1], g.left_op), pair(v[2], v[3], g.right_op))
    elif g.mode == "spread":
        out = pw.sub(p, ratio(v[0], v[1]), ratio(v[2], v[3]))
    elif g.mode == "style_composite":
        out = p.let(" + ".join(f"{d} * {cs.centred_rank(p, x)}" for d, x in zip(g.directions, v, strict=True)))
    else:  # residual on the sum of the controls, as one regressor
        out = cs.residual(p, v[0], v[1] if len(v) == 2 else p.let(" + ".join(v[1:])), flat="demean")
    if g.industry:
        out = cs.demean(p, out, "industry")
    if g.size:
        out = cs.residual(p, out, "size", flat="demean")
    return masks.tradeable_only(p, out)


@dataclass(frozen=True)
class Tree:
    """A slot's typed tree: a field, or a unary or binary operator."""

    op: str
    args: tuple[Tree, ...] = ()
    leaf: str = ""

    @property
    def depth(self) -> int:
        return 1 + max((a.depth for a in self.args), default=0)

    @property
    def size(self) -> int:
        return 1 + sum(a.size for a in self.args)

    @property
    def leaves(self) -> list[str]:
        return [self.leaf] if self.leaf else [x for a in self.args for x in a.leaves]

    @property
    def key(self) -> tuple:
        parts = [a.key for a in self.args]
        return (self.op, self.leaf, *(sorted(parts, key=repr) if self.op in ("mean", "interaction") else parts))

    def __str__(self) -> str:
        return self.leaf or f"{self.op}({', '.join(map(str, self.args))})"


def compile_tree(p: Layers, t: Tree) -> str:
    if t.leaf:
        return masks.tradeable_only(p, t.leaf)
    return (TREE_UNARY if len(t.args) == 1 else TREE_BINARY)[t.op](p, *[compile_tree(p, a) for a in t.args])


@dataclass(frozen=True)
class Slot:
    """A field with a transform and the field's direction, or a tree."""

    source: str | Tree
    transform: str = "rank_pct"
    direction: int = 1


@dataclass(frozen=True)
class Condition:
    field: str
    kind: str = "top_quantile"
    threshold: float = 0.6
    transform: str = "rank_pct"


@dataclass(frozen=True)
class BehaviourGene:
    """A mode's slots by name, joined by a combiner; conditions gate the result."""

    mode: str
    combiner: str
    slots: Mapping[str, Slot]
    conditions: tuple[Condition, ...] = ()
    fixed: bool = True

    @property
    def key(self) -> tuple:
        """Equal for genes of one meaning: slots and conditions may come in any order."""
        slots = sorted((k, s.source.key if isinstance(s.source, Tree) else (s.source, s.transform, s.direction)) for k, s in self.slots.items())
        return self.mode, self.combiner, repr(slots), repr(sorted(map(repr, self.conditions))), self.fixed

    def __str__(self) -> str:
        v = ", ".join(f"{k}={s.source if isinstance(s.source, Tree) else f'{s.transform}({s.source})'}" for k, s in self.slots.items())
        held = " and ".join(f"{c.kind}({c.field}, {c.threshold})" for c in self.conditions)
        return f"{self.mode}.{self.combiner}({v})" + (f" where {held}" if held else "")


@dataclass(frozen=True)
class Mode:
    """Slots in order ("?" marks optional ones), direction, combiners that may join them, and conditions at most."""

    slots: tuple[str, ...]
    direction: int
    combiners: tuple[str, ...]
    conditions: int = 1

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(s for s in self.slots if not s.endswith("?"))


#: The behaviour modes.
MODES = {
    "fund_price_underreaction": Mode(("fund_anchor", "price_reaction"), 1, ("rank_gap", "residual_gap", "gated_rank_gap")),
    "quality_neglect": Mode(("profit_growth", "cashflow_quality", "price_reaction?"), -1, ("quality_gap", "rank_gap", "gated_rank_gap")),
    "growth_crowding_risk": Mode(("growth_anchor", "crowding_signal", "fund_support?"), -1, ("crowding_interaction", "risk_minus_confirm")),
    "fund_flow_confirmation": Mode(("fund_anchor", "flow_confirm", "orderbook_filter?", "price_control?"), 1, ("confirm", "gated_confirm", "residual_gap"), 2),
    "retail_chase_risk": Mode(("price_momentum", "retail_flow", "close_chase", "large_flow?"), -1, ("risk_minus_confirm",), 2),
    "panic_reversal": Mode(("fund_anchor", "drawdown", "sell_pressure", "orderbook_filter?"), 1, ("panic_reversal",), 2),
    "attention_overreaction": Mode(("attention_heat", "price_momentum?", "fund_support?"), -1, ("attention_risk", "risk_minus_confirm", "gated_rank_gap")),
    "orderbook_intent": Mode(("orderbook_pressure", "liquidity_stress?", "price_reaction?"), 1, ("orderbook_intent",)),
    "liquidity_neglect": Mode(("liquidity_stress", "turnover_shock", "flow_confirm?"), -1, ("liquidity_gap", "risk_minus_confirm")),
    "anchor_momentum": Mode(("price_anchor", "price_momentum", "flow_confirm?", "orderbook_filter?"), 1, ("anchor_confirm", "confirm", "gated_confirm")),
    "disposition_anchor": Mode(("cost_anchor", "price_momentum", "fund_support?"), 1, ("residual_gap", "rank_gap", "anchor_confirm")),
}
#: Slots that count as risk or as confirmation, and slots that a confirming combiner doesn't add again.
RISK_SLOTS = ("crowding_signal", "retail_flow", "close_chase", "price_momentum", "attention_heat", "liquidity_stress", "turnover_shock")
CONFIRM_SLOTS = ("fund_support", "large_flow", "flow_confirm", "fund_anchor", "growth_anchor")
PRIMARY_SLOTS = ("fund_anchor", "flow_confirm", "price_anchor", "price_momentum")


def check_behaviour(g: BehaviourGene) -> list[str]:
    """What breaks the mode's rules; empty if nothing does."""
    if g.mode not in MODES:
        return [f"unknown mode {g.mode!r}"]
    m = MODES[g.mode]
    allowed = {s.rstrip("?") for s in m.slots}
    wrong = [f"slot {s!r} is missing" for s in m.required if s not in g.slots]
    wrong += [f"slot {s!r} isn't one of {g.mode}" for s in g.slots if s not in allowed]
    if g.combiner not in m.combiners:
        wrong.append(f"combiner {g.combiner!r} isn't one of {g.mode}")
    if len(g.conditions) > m.conditions:
        wrong.append(f"at most {m.conditions} conditions")
    wrong += [f"unknown transform {s.transform!r}" for s in g.slots.values() if isinstance(s.source, str) and s.transform not in BEHAVIOUR]
    return wrong + [f"unknown condition {c.kind!r}" for c in g.conditions if c.kind not in masks.CONDITIONS]


def combine(p: Layers, combiner: str, v: Mapping[str, str], crowding_weight: float = 0.5, skip: tuple[str, ...] = PRIMARY_SLOTS) -> str:
    """Slot columns, in mode order, joined by a combiner; optional slots that aren't there add nothing."""
    first, second = [*v.values(), None][:2]
    term = lambda name, form: f" {form.format(v[name])}" if name in v else ""
    if combiner in ("rank_gap", "gated_rank_gap"):
        return p.let(f"{first} - {second}") if second else first
    if combiner == "residual_gap":
        return cs.residual(p, first, second, flat="demean")
    if combiner == "quality_gap":
        return p.let(f"{v['profit_growth']} - {v['cashflow_quality']}" + term("price_reaction", "+ 0.25E0 * abs({})"))
    if combiner == "crowding_interaction":
        return p.let(f"{v['growth_anchor']} * {v['crowding_signal']}" + term("fund_support", f"- {crowding_weight} * {{}}"))
    if combiner in ("confirm", "gated_confirm"):
        out = f"{first} + {second} + {first} * {second}"
        for name, x in v.items():
            if name.endswith("control"):
                out += f" - 0.25E0 * abs({x})"
            elif name not in skip and x not in (first, second):
                out += f" + 0.5E0 * {x}"
        return p.let(out)
    if combiner == "risk_minus_confirm":
        risk = [x for k, x in v.items() if k in RISK_SLOTS]
        good = [x for k, x in v.items() if k in CONFIRM_SLOTS]
        if not risk:
            return p.let(f"{first} + {second}")
        return p.let("(" + " + ".join(risk) + ")" + "".join(f" - {x}" for x in good))
    if combiner == "panic_reversal":
        return p.let(f"{v['fund_anchor']} * {v['drawdown']} - {v['sell_pressure']}" + term("orderbook_filter", "+ {}"))
    if combiner == "attention_risk":
        return p.let(f"{v['attention_heat']}" + term("price_momentum", "+ {}") + term("fund_support", "- {}"))
    if combiner == "orderbook_intent":
        return p.let(f"{v['orderbook_pressure']}" + term("liquidity_stress", "- {}") + term("price_reaction", "- 0.25E0 * abs({})"))
    if combiner == "liquidity_gap":
        return p.let(f"{v['liquidity_stress']} - {v['turnover_shock']}" + term("flow_confirm", "- {}"))
    if combiner == "anchor_confirm":
        a, m = v.get("price_anchor") or v["cost_anchor"], v["price_momentum"]
        return p.let(f"{a} + {m} + {a} * {m}" + "".join(term(s, "+ 0.5E0 * {}") for s in ("flow_confirm", "orderbook_filter", "fund_support")))
    raise ValueError(f"unknown combiner {combiner!r}")


#: Names of a universe of several industries, and of one.
MANY_INDUSTRIES = {"all", "all_industries", "all-industry", "multi", "multiple"}


def neutralise_industry(scope: str | Sequence[str] | None) -> bool:
    """Whether factors of a universe should be freed of industries: for all or several of them, not for one or none."""
    if scope is None:
        return False
    if isinstance(scope, str):
        return scope.strip().lower() in MANY_INDUSTRIES
    names = {str(x).strip().lower() for x in scope} - {""}
    return len(names) > 1 or bool(names & MANY_INDUSTRIES)


@dataclass(frozen=True)
class Neutral:
    """What is taken out of a factor, in order: "size" (residual) and "industry" (group means)."""

    steps: tuple[str, ...] = field(default=())


def neutralise(p: Layers, x: str, steps: tuple[str, ...]) -> str:
    for s in steps:
        x = cs.residual(p, x, "size", flat="demean") if s == "size" else cs.demean(p, x, "industry")
    return x


def compile_behaviour(p: Layers, g: BehaviourGene, steps: tuple[str, ...] = (), fill: str = "nan") -> str:
    """Slots, combiner, conditions, direction if fixed, tradeable mask, neutralisation."""
    wrong = check_behaviour(g)
    if wrong:
        raise ValueError("; ".join(wrong))
    order = [s.rstrip("?") for s in MODES[g.mode].slots]
    v, trees = {}, any(isinstance(s.source, Tree) for s in g.slots.values())
    for name in order:
        if name in g.slots:
            s = g.slots[name]
            x = compile_tree(p, s.source) if isinstance(s.source, Tree) else BEHAVIOUR[s.transform](p, masks.tradeable_only(p, s.source), s.direction)
            v[name] = masks.tradeable_only(p, x)
    out = combine(p, g.combiner, v, 1.0 if trees else 0.5)
    if g.conditions:
        held = [masks.condition(p, BEHAVIOUR[c.transform](p, masks.tradeable_only(p, c.field), 1), c.kind, c.threshold) for c in g.conditions]
        out = masks.gate_all(p, out, held, fill)
    if g.fixed and MODES[g.mode].direction < 0:
        out = pw.neg(p, out)
    return neutralise(p, masks.tradeable_only(p, out), steps)
