"""A search from the command line: ``python -m quillon.run PANEL OUT --kind structured --cut 2023-01-01``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import asdict, replace

from pyspark.sql import SparkSession

from quillon.operators.configs import DEFAULTS, run
from quillon.plans.layers import DATE
from quillon.plans.panel import PanelContext, prepare
from quillon.plans.rules import infer_rules
from quillon.sources.tables import read_panel, write_results


def main(argv: Sequence[str] | None = None) -> None:
    """Search a panel file's fields on dates before a cut, judge what is found on the rest, and write ranked rows and settings."""
    a = argparse.ArgumentParser(description=main.__doc__)
    a.add_argument("panel")
    a.add_argument("out")
    a.add_argument("--kind", choices=list(DEFAULTS), default="structured")
    a.add_argument("--cut", required=True, help="first date to judge on")
    a.add_argument("--label", default="label")
    a.add_argument("--population", type=int)
    a.add_argument("--generations", type=int)
    args = a.parse_args(argv)
    settings = replace(DEFAULTS[args.kind], **{k: v for k in ("population", "generations") if (v := getattr(args, k)) is not None})
    spark = SparkSession.builder.getOrCreate()
    context = PanelContext(label=args.label)
    p = prepare(read_panel(spark, args.panel), context)
    found = run(p, settings, infer_rules(context.fields(p.base)), args.label, f"{DATE} < TIMESTAMP '{args.cut}'", f"{DATE} >= TIMESTAMP '{args.cut}'")
    write_results(found, asdict(settings), args.out)


if __name__ == "__main__":
    main()
