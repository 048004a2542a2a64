"""JSON texts as tables of their nodes."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "node integer, parent integer, depth integer, name string, place integer, kind string, value string"


class _Number(str):
    """A number as it is written."""


class _Pairs(list):
    """An object's names and values, repeated names included."""


def _no_constant(text: str):
    raise ValueError(text)


def walk(text: str | None) -> Iterator[tuple]:
    """(node, parent, depth, name, place, kind, value) of every value in a JSON text, each before what it holds and in order of the text.

    ``name`` is its name in an object, ``place`` its number in an array, ``value`` the text of a string, number or boolean.
    Texts that are null, no JSON, or nested deeper than the parser goes have no nodes.
    """
    if text is None:
        return
    try:
        top = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant, object_pairs_hook=_Pairs)
    except (ValueError, RecursionError):
        return
    stack, number = [(top, None, 0, None, None)], 0
    while stack:
        x, parent, depth, name, place = stack.pop()
        below: list[tuple] = []
        if isinstance(x, _Pairs):
            kind, value = "object", None
            below = [(v, number, depth + 1, k, None) for k, v in x]
        elif isinstance(x, list):
            kind, value = "array", None
            below = [(v, number, depth + 1, None, i) for i, v in enumerate(x)]
        elif isinstance(x, bool):
            kind, value = "boolean", str(x).lower()
        else:
            kind, value = ("null", None) if x is None else ("number" if isinstance(x, _Number) else "string", str(x))
        yield number, parent, depth, name, place, kind, value
        number += 1
        stack += reversed(below)


def json_nodes(rows: DataFrame, text: str, keep: Sequence[str], parents: bool = False) -> DataFrame:
    """``keep`` columns with a row for every node of the JSON in ``text``, as ``walk`` says; one scan, no exchange.

    ``parents`` adds ``parent_name``, the name that the node's parent has. A text's nodes are all at hand when it is walked,
    so nothing is joined.
    """
    at = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("_json"))
    columns_of = NODES + (", parent_name string" if parents else "")
    names = [c.split(" ")[0] for c in columns_of.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()][: len(names)]

    def run(batches):
        for batch in batches:
            owner, found = [], []
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                nodes = list(walk(t))
                if parents:
                    nodes = [(*n, None if n[1] is None else nodes[n[1]][3]) for n in nodes]
                owner += [i] * len(nodes)
                found += nodes
            columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
            kept = [batch.column(k).take(pa.array(owner, pa.int32())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=[*keep, *names])

    schema = at.select(*[F.col(f"`{c}`") for c in keep]).schema
    for c in columns_of.split(", "):
        schema = schema.add(*c.split(" "))
    return at.mapInArrow(run, schema)
