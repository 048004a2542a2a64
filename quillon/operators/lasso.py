"""Selection of fields by Lasso over ranked, standardised factors, with expanding folds of dates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import cross_section as cs
from quillon.functions import masks
from quillon.plans.layers import DATE, SparkPanel

KEPT = 1e-8


def solve(gram: np.ndarray, right: np.ndarray, alpha: float, rounds: int = 1000) -> np.ndarray:
    """Coordinate descent for min b'Gb / 2 - r'b + alpha |b|, with mean moments G and r."""
    b = np.zeros(len(right))
    for _ in range(rounds):
        before = b.copy()
        for j in range(len(b)):
            if gram[j, j] > 0:
                rest = right[j] - gram[j] @ b + gram[j, j] * b[j]
                b[j] = np.sign(rest) * max(0.0, abs(rest) - alpha) / gram[j, j]
        if np.abs(b - before).max(initial=0) < 1e-10:
            break
    return b


def select_fields(df: DataFrame, fields: Sequence[str], label: str, alphas: Sequence[float] | None = None, folds: int = 5, parts: int | None = None) -> DataFrame:
    """(field, coefficient, kept) at the penalty with the least squared error over folds, each trained on all dates before it.

    One pass sums the moments of every fold; all fits and errors follow from those few numbers, so the rows are neither
    cached nor read again. ``parts`` as in ``SparkPanel``.
    """
    alphas = np.logspace(-5, -1, 50) if alphas is None else alphas
    p = SparkPanel(df, parts=parts)
    z = lambda c: cs.zscore(p, cs.rank_pct(p, masks.tradeable_only(p, c)), flat="zero")
    x = [z(f) for f in fields]
    y = z(label)
    cols = [*x, y]
    rows = p.frame(cols, []).where(" AND ".join(f"{c} IS NOT NULL" for c in cols))
    cuts = df.select(DATE).distinct().select(F.expr(f"percentile(unix_timestamp({DATE}), array({', '.join(str(i / (folds + 1)) for i in range(1, folds + 1))}))")).first()[0]
    part = sum((F.when(F.unix_timestamp(DATE) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    k = len(cols)
    sums = [F.sum(F.expr(f"{cols[i]} * {cols[j]}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    got = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), *sums).collect()
    n, m = np.zeros(folds + 1), np.zeros((folds + 1, k, k))
    for r in got:
        n[r["part"]] = r["n"]
        for i in range(k):
            for j in range(i, k):
                m[r["part"], i, j] = m[r["part"], j, i] = r[f"m{i}_{j}"]

    def fit(upto: int, alpha: float) -> np.ndarray:
        g, size = m[:upto].sum(0), max(1.0, n[:upto].sum())
        return solve(g[:-1, :-1] / size, g[:-1, -1] / size, alpha)

    def error(alpha: float) -> float:
        total = 0.0
        for t in range(1, folds + 1):
            b = np.append(fit(t, alpha), -1.0)
            total += b @ m[t] @ b / max(1.0, n[t])
        return total

    best = min(alphas, key=error)
    coefficients = fit(folds + 1, best)
    return df.sparkSession.createDataFrame([(f, float(round(c, 6)), bool(abs(c) > KEPT)) for f, c in zip(fields, coefficients, strict=True)], "field string, coefficient double, kept boolean")
