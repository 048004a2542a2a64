"""Free-form programs: typed expression trees, their checks, and their compilation to layered plans."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace

from quillon.functions import masks
from quillon.functions import pointwise as pw
from quillon.functions.registry import OPERATORS, Operator
from quillon.plans.layers import Layers

COMMUTATIVE = {"add", "mul"}
CONST_COST = 0.05
#: Names of the children of each kind of node in JSON, in order.
CHILDREN = {"field": (), "const": (), "unary": ("child",), "binary": ("left", "right"), "gate": ("signal", "mask")}


@dataclass(frozen=True)
class Node:
    """A field, a constant, or an operator over child nodes; ``value`` is the field's name, the number or the operator's name."""

    kind: str
    value: str | float
    args: tuple[Node, ...] = ()

    def walk(self) -> Iterator[Node]:
        yield self
        for a in self.args:
            yield from a.walk()

    @property
    def operator(self) -> Operator | None:
        return OPERATORS.get(str(self.value)) if self.args else None

    @property
    def output(self) -> str:
        return self.operator.output if self.operator else "numeric"

    @property
    def size(self) -> int:
        return sum(1 for _ in self.walk())

    @property
    def depth(self) -> int:
        return 1 + max((a.depth for a in self.args), default=0)

    @property
    def cost(self) -> float:
        own = CONST_COST if self.kind == "const" else OPERATORS[str(self.value)].cost if self.args else 0.0
        return own + sum(a.cost for a in self.args)

    @property
    def fields(self) -> list[str]:
        return list(dict.fromkeys(str(n.value) for n in self.walk() if n.kind == "field"))

    @property
    def operators(self) -> list[str]:
        return [str(n.value) for n in self.walk() if n.args]

    @property
    def key(self) -> tuple:
        """Equal for programs that differ only in the order of commutative arguments."""
        if self.kind == "const":
            return "const", round(float(self.value), 12)
        parts = [a.key for a in self.args]
        return (self.kind, self.value, *(sorted(parts, key=repr) if self.value in COMMUTATIVE else parts))

    def __str__(self) -> str:
        if self.kind == "const":
            return f"{float(self.value):.6g}"
        return f"{self.value}({', '.join(map(str, self.args))})" if self.args else str(self.value)

    def to_dict(self) -> dict:
        name = {"field": "field", "const": "value"}.get(self.kind, "op")
        return {"node": self.kind, name: self.value} | {c: a.to_dict() for c, a in zip(CHILDREN[self.kind], self.args, strict=True)}

    @classmethod
    def from_dict(cls, raw: Mapping) -> Node:
        kind = raw.get("node")
        if kind not in CHILDREN:
            raise ValueError(f"unknown node {kind!r}")
        value = str(raw["field"]) if kind == "field" else float(raw["value"]) if kind == "const" else str(raw["op"])
        return cls(kind, value, tuple(cls.from_dict(raw[c]) for c in CHILDREN[kind]))

    def with_at(self, index: int, new: Node) -> Node:
        """A copy in which the node at position ``index`` of the walk is ``new``."""
        if index == 0:
            return new
        at, out = 1, []
        for a in self.args:
            out.append(a.with_at(index - at, new) if at <= index < at + a.size else a)
            at += a.size
        return replace(self, args=tuple(out))


def field(name: str) -> Node:
    return Node("field", name)


def const(value: float) -> Node:
    return Node("const", float(value))


def call(op: str, *args: Node) -> Node:
    """An operator over arguments, as the kind of node its category asks for."""
    gate = op in OPERATORS and OPERATORS[op].category == "gate"
    return Node("gate" if gate else "unary" if len(args) == 1 else "binary", op, tuple(args))


@dataclass(frozen=True)
class Program:
    """One expression; its root is numeric."""

    root: Node
    version: int = 1

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "root": self.root.to_dict()}, ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Program:
        raw = json.loads(text)
        if not isinstance(raw, Mapping) or not isinstance(raw.get("root"), Mapping):
            raise TypeError("a program is an object with a root")
        return cls(Node.from_dict(raw["root"]), int(raw.get("version", 1)))

    @property
    def key(self) -> tuple:
        return self.version, self.root.key

    def __str__(self) -> str:
        return str(self.root)

    @property
    def lookback(self) -> int:
        """Rows before a date that its value depends on: the longest chain of windows."""
        return _lookback(self.root)


def _lookback(n: Node) -> int:
    digits = [x for x in str(n.value).split("_") if x.isdigit()] if n.operator and n.operator.category == "time_series" else []
    return (int(digits[0]) if digits else 0) + max((_lookback(a) for a in n.args), default=0)


def check(program: Program, fields: Iterable[str] | None = None, max_depth: int | None = None, max_size: int | None = None) -> list[str]:
    """Everything wrong with a program; empty if it is valid."""
    known = None if fields is None else set(fields)
    wrong = []
    for n in program.root.walk():
        if n.kind == "field" and (not n.value or known is not None and n.value not in known):
            wrong.append(f"unknown field {n.value!r}")
        elif n.kind == "const" and not math.isfinite(float(n.value)):
            wrong.append("a constant must be finite")
        elif n.args:
            op = n.operator
            if op is None:
                wrong.append(f"unknown operator {n.value!r}")
                continue
            if op.arity != len(n.args):
                wrong.append(f"{n.value} takes {op.arity} arguments")
            if (op.category == "gate") != (n.kind == "gate"):
                wrong.append(f"{n.value} stands in a {n.kind} node")
            wants = ["numeric", "mask"] if n.kind == "gate" else ["numeric"] * len(n.args)
            wrong += [f"{n.value} needs a {w} argument, not {a}" for w, a in zip(wants, n.args, strict=False) if a.output != w]
    if program.root.output != "numeric":
        wrong.append("the root must be numeric")
    if max_depth is not None and program.root.depth > max_depth:
        wrong.append(f"deeper than {max_depth}")
    if max_size is not None and program.root.size > max_size:
        wrong.append(f"larger than {max_size}")
    return wrong


def compile_node(p: Layers, n: Node, mask_inputs: bool = True) -> str:
    """Add a tree's columns to a panel and return the root's. Equal subtrees become one column."""
    if n.kind == "const":
        return pw.constant(p, float(n.value))
    if n.kind == "field":
        return masks.tradeable_only(p, str(n.value)) if mask_inputs else str(n.value)
    args = [compile_node(p, a, mask_inputs) for a in n.args]
    if n.value in COMMUTATIVE:
        args.sort()
    return OPERATORS[str(n.value)].build(p, *args)


def compile_program(p: Layers, program: Program, mask_inputs: bool = True, mask_output: bool = True) -> str:
    """The column of a program's value over the whole history; dates are cut afterwards."""
    out = compile_node(p, program.root, mask_inputs)
    return masks.tradeable_only(p, out) if mask_output else out
