"""Field metadata: from names, from markdown field tables, from screening files; and what behaviour genes may do with a field."""

from __future__ import annotations

import argparse
import csv
import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import recipes
from quillon.plans import rules
from quillon.plans.layers import DATE, NAME
from quillon.plans.templates import BEHAVIOUR, MODES

def slots() -> tuple[str, ...]:
    """All slots of the behaviour modes."""
    return tuple(dict.fromkeys(s.rstrip("?") for m in MODES.values() for s in m.slots))


def behaviour_rule(name: str, rule: rules.FieldRule | None = None) -> dict:
    """What behaviour genes may do with a field: its data family, the slots it may fill, the transforms it takes, its direction."""
    rule = rule or rules.infer_rules([name])[name]
    family = rules.KIND_FAMILY.get(rule.kind, "control")
    words = rules.SLOT_FAMILIES.get(family, ())
    fits = [s for s in slots() if any(w in s for w in words)]
    transforms = [t for t in BEHAVIOUR if rule.industry or not t.startswith("ind_")]
    return {"data_family": family, "kind": rule.kind, "direction": rule.direction, "allowed_slots": fits, "allowed_transforms": transforms, "conditions": family != "control"}


def behaviour_metadata(names: Sequence[str], known: Mapping[str, dict] | None = None) -> dict[str, dict]:
    """Behaviour rules of fields; what is known of one stays, what isn't is classified."""
    return {n: (known or {}).get(n) or behaviour_rule(n) for n in names}


def candidates(metadata: Mapping[str, dict], slot: str) -> list[str]:
    """Fields that may fill a slot."""
    return [n for n, r in metadata.items() if slot in r["allowed_slots"]]


def sync(metadata: dict, columns: Iterable[str]) -> tuple[dict, list[str], list[str]]:
    """Metadata of just the columns there are: (metadata, names added, names dropped)."""
    columns = list(columns)
    added, dropped = [c for c in columns if c not in metadata], [c for c in metadata if c not in columns]
    return behaviour_metadata(columns, metadata), added, dropped


def panel_metadata(df: DataFrame) -> dict:
    """Rules of a panel's numeric columns, and its shape, from names and one aggregate."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    names = [c for c, t in df.dtypes if t in kinds and c not in (DATE, NAME)]
    row = df.agg(F.count("*").alias("n"), F.count_distinct(DATE).alias("d"), F.count_distinct(NAME).alias("c")).first()
    return {"index": [DATE, NAME], "shape": [row["n"], len(df.columns)], "n_dates": row["d"], "n_contracts": row["c"], "field_rules": {n: asdict(r) for n, r in rules.infer_rules(names).items()}, "behavior_field_rules": behaviour_metadata(names)}


def recipe_names() -> list[str]:
    """Every derived column that the recipes make."""
    return list(dict.fromkeys(n for names in recipes.registry().values() for n in names))


_ROW = re.compile(r"^\s*\|(.+)\|\s*$")
_RULE = re.compile(r"^\s*\|?[\s:|-]+\|?\s*$")
_NAME = re.compile(r"^[A-Za-z_]\w*$")


def markdown_fields(text: str, section: str | None = None) -> dict[str, dict[str, str]]:
    """Fields of a document's tables and code blocks: name -> cells by heading; the first mention stays.

    A table's first column holds the names, in backticks or not; a line of a code block that is a name is a field without
    cells. ``section``: only under headings that start so.
    """
    out: dict[str, dict[str, str]] = {}
    inside, code, heads = section is None, False, None
    for line in text.splitlines():
        if line.startswith("#") and not code:
            inside, heads = section is None or line.lstrip("# ").startswith(section), None
            continue
        if line.strip().startswith("```"):
            code, heads = not code, None
            continue
        if not inside:
            continue
        if code:
            for w in re.split(r"[\s,]+", line.strip()):
                if _NAME.match(w):
                    out.setdefault(w, {})
        elif (m := _ROW.match(line)) and not _RULE.match(line):
            cells = [c.strip().strip("`") for c in m[1].split("|")]
            if heads is None:
                heads = cells
            elif _NAME.match(cells[0]):
                out.setdefault(cells[0], dict(zip(heads[1:], cells[1:], strict=False)))
        elif not _RULE.match(line):
            heads = None
    return out


def screened_fields(path: str) -> list[str]:
    """Names in a screening file: a JSON list or object with ``selected_fields``, a csv with a column ``field``, or a name per line."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith(".json"):
        raw = json.loads(text)
        return list(dict.fromkeys(raw["selected_fields"] if isinstance(raw, dict) else raw))
    rows = list(csv.reader(text.splitlines()))
    if rows and "field" in rows[0]:
        return list(dict.fromkeys(r[rows[0].index("field")] for r in rows[1:] if r))
    return list(dict.fromkeys(r[0].strip() for r in rows if r and r[0].strip()))


def screened_metadata(path: str, known: Mapping[str, dict] | None = None) -> dict:
    """Rules of the fields a screening chose."""
    names = screened_fields(path)
    return {"selected_fields": names, "field_rules": {n: asdict(r) for n, r in rules.infer_rules(names).items()}, "behavior_field_rules": behaviour_metadata(names, known)}


def main(argv: Sequence[str] | None = None) -> None:
    """Write metadata of a panel's columns, a screening file or a markdown document to a JSON file."""
    a = argparse.ArgumentParser(description=main.__doc__)
    a.add_argument("source")
    a.add_argument("target")
    a.add_argument("--known", help="JSON metadata whose behaviour rules stay")
    args = a.parse_args(argv)
    known = json.loads(Path(args.known).read_text(encoding="utf-8")).get("behavior_field_rules") if args.known else None
    if args.source.endswith(".md"):
        names = list(markdown_fields(Path(args.source).read_text(encoding="utf-8")))
        out = {"selected_fields": names, "field_rules": {n: asdict(r) for n, r in rules.infer_rules(names).items()}, "behavior_field_rules": behaviour_metadata(names, known)}
    elif args.source.endswith((".json", ".csv", ".txt")):
        out = screened_metadata(args.source, known)
    else:
        from pyspark.sql import SparkSession

        out = panel_metadata(SparkSession.builder.getOrCreate().read.parquet(args.source))
    Path(args.target).write_text(json.dumps(out, ensure_ascii=False, indent=2), encoding="utf-8")


if __name__ == "__main__":
    main()
