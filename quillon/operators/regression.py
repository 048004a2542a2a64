"""Cross-sectional regressions with any number of controls, solved date by date in columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.layers import DATE, NAME

#: A control of which less than this part is left, once the controls before it are taken out, tells nothing more.
COLLINEAR = 1e-10


def residuals(df: DataFrame, y: str, controls: Sequence[str], ridge: float = 1e-6, into: str = "residual") -> DataFrame:
    """``df`` with the residual of y on an intercept and all controls jointly, date by date.

    Only rows with y and all controls known count; a date needs len(controls) + 2 of them, otherwise its residuals are
    missing. Without controls the residual is y less its mean. On dates without full rank, controls that follow from those
    before them take nothing out, which leaves the residual of the rest.

    Moments are windows over one exchange by date, and the equations are eliminated in columns of the same rows: the table
    is planned once, and no row and no moment leaves the engine.
    """
    k, taken = len(controls), set(df.columns)
    prefix = next(p for p in (f"_rg{i}_" for i in range(1000)) if not any(c.startswith(p) for c in taken))
    c = lambda name: F.col(prefix + name)
    add = lambda d, columns: d.withColumns({prefix + name: x for name, x in columns.items()})
    by, known = Window.partitionBy(DATE), F.lit(True)
    for x in (y, *controls):
        known &= F.expr(x).isNotNull()
    d = add(df, {"k": known})
    values = {"y": y} | {f"x{i}": x for i, x in enumerate(controls)}
    value = {v: F.when(c("k"), F.expr(x).cast("double")) for v, x in values.items()}
    d = add(d, {"n": F.count_if(c("k")).over(by), **{v: x - F.avg(x).over(by) for v, x in value.items()}})
    products = {f"s{i}_{j}": c(f"x{i}") * c(f"x{j}") for i in range(k) for j in range(i + 1)} | {f"t{i}": c(f"x{i}") * c("y") for i in range(k)}
    d = add(d, {name: F.coalesce(F.sum(x).over(by), F.lit(0.0)) for name, x in products.items()})
    if ridge:
        d = add(d, {f"s{i}_{i}": c(f"s{i}_{i}") + ridge for i in range(k)})
    # S = L D L': d<i> are the pivots, l<i>_<j> what control j takes out of i, z<i> the right side without the controls before.
    for j in range(k):
        pivot, right = c(f"s{j}_{j}"), c(f"t{j}")
        for q in range(j):
            pivot -= c(f"l{j}_{q}") * c(f"l{j}_{q}") * c(f"d{q}")
            right -= c(f"l{j}_{q}") * c(f"z{q}")
        d = add(d, {f"d{j}": F.when(pivot > COLLINEAR * c(f"s{j}_{j}"), pivot).otherwise(0.0), f"z{j}": right})
        below = {}
        for i in range(j + 1, k):
            left = c(f"s{i}_{j}")
            for q in range(j):
                left -= c(f"l{i}_{q}") * c(f"l{j}_{q}") * c(f"d{q}")
            below[f"l{i}_{j}"] = F.when(c(f"d{j}") > 0, left / c(f"d{j}")).otherwise(0.0)
        d = add(d, below) if below else d
    for j in reversed(range(k)):
        beta = c(f"z{j}") / c(f"d{j}")
        for i in range(j + 1, k):
            beta -= c(f"l{i}_{j}") * c(f"b{i}")
        d = add(d, {f"b{j}": F.when(c(f"d{j}") > 0, beta).otherwise(0.0)})
    left = c("y")
    for j in range(k):
        left -= c(f"b{j}") * c(f"x{j}")
    kept = [F.col(f"`{x}`") for x in df.columns if x != into]
    return d.select(*kept, F.when(c("n") >= k + 2, left).alias(into))


def style_correlations(df: DataFrame, factor: str, styles: Sequence[str]) -> dict[str, float]:
    """|mean daily correlation| of a factor with each style; dates without spread are left out."""
    daily = df.groupBy(DATE).agg(*[F.expr(_corr(factor, s)).alias(s) for s in styles])
    row = daily.agg(*[F.abs(F.avg(s)).alias(s) for s in styles]).first()
    return {s: float(row[s]) if row[s] is not None else 0.0 for s in styles}


def _corr(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"CASE WHEN count({x}) >= 3 AND var_pop({x}) > 1E-14 AND var_pop({y}) > 1E-14 THEN covar_pop({x}, {y}) / (sqrt(var_pop({x})) * sqrt(var_pop({y}))) END"


def standardise(df: DataFrame, columns: Sequence[str], where: str = "TRUE") -> DataFrame:
    """Columns as z-scores of each date over the rows that ``where`` keeps; missing elsewhere and on dates without spread."""
    w = Window.partitionBy(DATE)
    for c in columns:
        x = F.when(F.expr(where), F.col(c))
        s = F.stddev_samp(x).over(w)
        df = df.withColumn(c, F.when(s > 1e-8, (x - F.avg(x).over(w)) / (s + 1e-8)))
    return df


def require_styles(styles: Sequence[str], groups: bool, mode: str = "full", number: int = 10) -> str | None:
    """What full neutralisation lacks: its exact number of styles, or the groups; None if nothing, or if the mode isn't full."""
    if mode != "full":
        return None
    if len(styles) != number:
        return f"full neutralisation needs {number} styles, not {len(styles)}"
    return None if groups else "full neutralisation needs groups"


def neutralise_dynamic(df: DataFrame, factor: str, styles: Sequence[str], threshold: float = 0.3, most: int = 2, into: str = "residual", restandardise: bool = False) -> tuple[DataFrame, list[str]]:
    """Residual on the ``most`` styles whose |mean correlation| passes the threshold, and their names; unchanged without any.

    ``restandardise`` takes styles as z-scores over the names that have the factor, whatever scale they come in; the panel
    keeps them as they were.
    """
    if restandardise:
        names = [f"_z_{s}" for s in styles]
        d = standardise(df.withColumns({z: F.col(s) for z, s in zip(names, styles, strict=True)}), names, f"{factor} IS NOT NULL")
        out, picked = neutralise_dynamic(d, factor, names, threshold, most, into)
        return out.drop(*names), [p.removeprefix("_z_") for p in picked]
    corr = style_correlations(df, factor, styles)
    picked = [s for s in sorted(styles, key=lambda s: (-corr[s], s)) if corr[s] > threshold][:most]
    return (residuals(df, factor, picked, into=into) if picked else df.withColumn(into, F.col(factor))), picked


def neutralise_full(df: DataFrame, factor: str, styles: Sequence[str], group: str = "industry", jointly: bool = True, into: str = "residual", restandardise: bool = False, ridge: float = 1e-6) -> DataFrame:
    """Residual on all styles and the groups: jointly (styles and factor demeaned by group first), or styles first, group means after.

    Only rows with factor, group and all styles count. ``restandardise`` takes styles as z-scores over those rows; a style
    without spread on a date is 0 there and takes nothing out.
    """
    if restandardise:
        names = [f"_z_{s}" for s in styles]
        known = " AND ".join(f"{c} IS NOT NULL" for c in (factor, group, *styles))
        d = standardise(df.withColumns({z: F.col(s) for z, s in zip(names, styles, strict=True)}), names, known)
        d = d.withColumns({z: F.when(F.expr(known), F.coalesce(F.col(z), F.lit(0.0))) for z in names})
        return neutralise_full(d, factor, names, group, jointly, into, ridge=ridge).drop(*names)
    if not jointly:
        known = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in (group, *styles)))
        d = residuals(df.withColumn("_y", F.when(known, F.col(factor))), "_y", styles, ridge, "_r").drop("_y")
        mean = F.avg("_r").over(_by(group))
        return d.withColumn(into, F.when(F.col(group).isNotNull(), F.col("_r") - mean)).drop("_r")
    known = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in (factor, group, *styles)))
    d = df
    for c in (factor, *styles):
        v = F.when(known, F.col(c))
        d = d.withColumn(f"_{c}", v - F.avg(v).over(_by(group)))
    return residuals(d, f"_{factor}", [f"_{s}" for s in styles], ridge, into).drop(*[f"_{c}" for c in (factor, *styles)])


def size_neutral(df: DataFrame, factor: str, size: str = "market_cap", logged: bool | None = None, into: str = "residual", ridge: float = 1e-6) -> DataFrame:
    """Residual on size. Only a field named market_cap is taken as its signed logarithm, unless told; a field that isn't there is an error."""
    if size not in df.columns:
        raise KeyError(f"no size field {size!r}")
    take = size == "market_cap" if logged is None else logged
    x = F.signum(size) * F.log1p(F.abs(F.col(size))) if take else F.col(size)
    return residuals(df.withColumn("_size", x), factor, ["_size"], ridge, into).drop("_size")


def _by(group: str):
    return Window.partitionBy(DATE, group)


KEYS = (DATE, NAME)
