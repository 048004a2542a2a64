"""The whole bundle of a factor's metrics from one plan, and a facade that scores columns and programs with it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import cross_section as cs
from quillon.functions import masks
from quillon.functions import pointwise as pw
from quillon.operators import metrics as mt
from quillon.plans.layers import DATE, NAME, Layers, SparkPanel
from quillon.plans.program import Program, check, compile_program
from quillon.plans.storage import without_shuffles
from quillon.plans.templates import neutralise

#: What a search may maximise, by name of the mode.
OBJECTIVES = {
    "structured": ("rank_ic_ir", "ndcg", "neutral_rank_ic_ir"),
    "behaviour": ("rank_ic_ir", "long_rank_ic_ir", "ndcg"),
    "behaviour_pair": ("rank_ic_ir", "long_rank_ic_ir"),
    "behaviour_neutral": ("rank_ic_ir", "long_rank_ic_ir", "neutral_rank_ic_ir"),
}
_SERIES = ("ic", "rank_ic", "up_ic", "up_rank_ic", "down_ic", "down_rank_ic", "neutral_rank_ic")
_MEANS = ("coverage", "up_ndcg", "down_ndcg", "up_turnover", "down_turnover", "stability")


@dataclass(frozen=True)
class ScorerConfig:
    """How a factor is scored. ``steps`` are what the neutralised metrics take out, in order; none leaves them at 0."""

    rules: mt.MetricRules = mt.STRUCTURED
    ndcg_k: int | None = None
    ndcg_fraction: float = 0.1
    bins: int = 10
    own_bins: bool = True
    direction: int | None = None
    steps: tuple[str, ...] = ()
    mask_inputs: bool = True
    mask_factor: bool = True

    def __post_init__(self) -> None:
        wrong = [
            why
            for bad, why in (
                (self.ndcg_k is not None and self.ndcg_k < 1, "ndcg_k must be positive"),
                (not 0 < self.ndcg_fraction <= 1, "ndcg_fraction must be in (0, 1]"),
                (self.bins < 2, "bins must be 2 at least"),
                (self.direction not in (None, 1, -1), "direction must be 1, -1 or left out"),
                (self.rules.least < 2, "a cross-section has 2 names at least"),
                (set(self.steps) - {"size", "industry"}, "steps are size and industry"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))


@dataclass(frozen=True)
class FactorScore:
    """Means are as they are; ratios and win rates are in the factor's direction, and so are the long side, NDCG and turnover. Nothing known scores zero."""

    direction: int = 1
    days: int = 0
    mean_ic: float = 0.0
    ic_ir: float = 0.0
    mean_rank_ic: float = 0.0
    rank_ic_ir: float = 0.0
    win: float = 0.0
    long_ic: float = 0.0
    long_ic_ir: float = 0.0
    long_rank_ic: float = 0.0
    long_rank_ic_ir: float = 0.0
    ndcg: float = 0.0
    coverage: float = 0.0
    turnover: float = 0.0
    stability: float = 0.0
    neutral_rank_ic: float = 0.0
    neutral_rank_ic_ir: float = 0.0
    neutral_win: float = 0.0
    neutral_days: int = 0
    error: str = ""

    @property
    def ic(self) -> float:
        return self.mean_rank_ic

    @property
    def ir(self) -> float:
        return self.rank_ic_ir

    def objectives(self, mode: str) -> tuple[float, ...]:
        if mode not in OBJECTIVES:
            raise ValueError(f"objectives are {', '.join(OBJECTIVES)}")
        return tuple(float(getattr(self, n)) for n in OBJECTIVES[mode])

    def signed(self) -> dict[str, float]:
        """A flat row in which means have the factor's direction."""
        row = {k: float(v) for k, v in asdict(self).items() if k != "error"}
        return row | {k: row[k] * self.direction for k in ("mean_ic", "mean_rank_ic", "neutral_rank_ic")}


#: What a factor scores of which nothing is known, and what one scores that must lose against every other.
EMPTY, WORST = FactorScore(), FactorScore(**{f.name: float("-inf") for f in fields(FactorScore) if f.name not in ("direction", "days", "neutral_days", "error")})


def daily_aggregates(p: Layers, factor: str, label: str, c: ScorerConfig = ScorerConfig()) -> tuple[dict[str, str], list[str]]:
    """(aggregates of one date by name, columns they need). Both directions are there, as the sign is only known at the end."""
    cols: list[str] = []

    def corr(x: str, y: str, ranked: bool) -> str:
        x, y = mt.joint(p, x, y)
        if ranked:
            x, y = cs.average_rank(p, x), cs.average_rank(p, y)
        cols.extend((x, y))
        return mt.correlation(x, y, c.rules.least)

    def rank_corr(x: str, y: str) -> str:
        return corr(x, y, True) if c.rules.joint else corr(cs.average_rank(p, x), cs.average_rank(p, y), False)

    x, y = mt.masked(p, factor, label, c.mask_factor)
    out = {"ic": corr(x, y, False), "rank_ic": rank_corr(x, y)}
    for side, v in (("up", x), ("down", pw.neg(p, x))):
        long = masks.gate_nan(p, v, masks.top_half(p, v))
        out[f"{side}_ic"], out[f"{side}_rank_ic"] = corr(long, y, False), rank_corr(long, y)
        known, place, best, gain, at = mt.ndcg_columns(p, v, y, c.ndcg_k, c.ndcg_fraction, c.bins, c.own_bins)
        part = lambda i: f"sum(CASE WHEN {known} = 1 AND {i} <= {at} THEN {gain} / (ln({i} + 1) / ln(2.0E0)) END)"  # noqa: E731, B023
        out[f"{side}_ndcg"] = f"CASE WHEN {part(best)} > 0 AND count(CASE WHEN {known} = 1 THEN 1 END) >= {1 if c.own_bins else 2} THEN {part(place)} / {part(best)} END"
        now, before = mt.turnover_columns(p, v, c.ndcg_k, c.ndcg_fraction)
        out[f"{side}_turnover"] = f"sum(CASE WHEN {now} IS NOT NULL AND {before} IS NOT NULL THEN abs({now} - {before}) END) / 2"
        cols += [known, place, best, gain, at, now, before]
    out["stability"] = corr(masks.tradeable_only(p, factor), p.let(f"lead({masks.tradeable_only(p, factor)}) OVER (PARTITION BY {NAME} ORDER BY {DATE})"), False)
    out["neutral_rank_ic"] = rank_corr(neutralise(p, x, c.steps), y) if c.steps else "CAST(NULL AS DOUBLE)"
    out["coverage"] = f"count({x}) * 1.0E0 / nullif(count(CASE WHEN tradeable THEN 1 END), 0)"
    cols.append(x)
    return out, list(dict.fromkeys(cols))


def total_aggregates(suffix: str = "") -> dict[str, str]:
    """Aggregates over dates of the daily ones, by name."""
    out = {f"{s}_{k}{suffix}": e.format(s + suffix) for s in _SERIES for k, e in (("m", "avg({0})"), ("s", "stddev_samp({0})"), ("n", "count({0})"), ("u", "count(CASE WHEN {0} > 1E-9 THEN 1 END)"), ("d", "count(CASE WHEN {0} < -1E-9 THEN 1 END)"))}
    return out | {f"{m}_m{suffix}": f"avg({m}{suffix})" for m in _MEANS}


def finish(row: Mapping[str, float | None], c: ScorerConfig = ScorerConfig(), suffix: str = "") -> FactorScore:
    """The score from the totals."""
    v = lambda k: row[k + suffix] or 0
    ratio = lambda s: v(f"{s}_m") / v(f"{s}_s") if v(f"{s}_n") > 1 and v(f"{s}_s") > 1e-12 else 0.0
    if not v("rank_ic_n"):
        return FactorScore(coverage=float(v("coverage_m")))
    d = c.direction or (1 if v("rank_ic_m") >= 0 else -1)
    side, wins = ("up", "u") if d > 0 else ("down", "d")
    neutral = v("neutral_rank_ic_n")
    return FactorScore(
        d, int(v("rank_ic_n")), float(v("ic_m")), d * ratio("ic"), float(v("rank_ic_m")), d * ratio("rank_ic"), v(f"rank_ic_{wins}") / v("rank_ic_n"),
        float(v(f"{side}_ic_m")), ratio(f"{side}_ic"), float(v(f"{side}_rank_ic_m")), ratio(f"{side}_rank_ic"), float(v(f"{side}_ndcg_m")), float(v("coverage_m")), float(v(f"{side}_turnover_m")), float(v("stability_m")),
        float(v("neutral_rank_ic_m")), d * ratio("neutral_rank_ic"), v(f"neutral_rank_ic_{wins}") / neutral if neutral else 0.0, int(neutral),
    )


def bundle_sql(p: Layers, factor: str, label: str, c: ScorerConfig = ScorerConfig()) -> tuple[str, list[str]]:
    """The score as one SQL row over {panel}."""
    daily, cols = daily_aggregates(p, factor, label, c)
    d = str(c.direction) if c.direction else "CASE WHEN coalesce(rank_ic_m, 0) >= 0 THEN 1 ELSE -1 END"
    ratio = lambda s: f"CASE WHEN {s}_n > 1 AND {s}_s > 1E-12 THEN {s}_m / {s}_s ELSE 0 END"
    side = lambda k: f"CASE WHEN direction > 0 THEN {k.format('up')} ELSE {k.format('down')} END"
    wins = lambda s: f"CASE WHEN {s}_n > 0 THEN CASE WHEN direction > 0 THEN {s}_u ELSE {s}_d END * 1.0E0 / {s}_n ELSE 0 END"
    out = {
        "mean_ic": "ic_m", "ic_ir": f"direction * {ratio('ic')}", "mean_rank_ic": "rank_ic_m", "rank_ic_ir": f"direction * {ratio('rank_ic')}", "win": wins("rank_ic"),
        "long_ic": side("{}_ic_m"), "long_ic_ir": f"CASE WHEN direction > 0 THEN {ratio('up_ic')} ELSE {ratio('down_ic')} END", "long_rank_ic": side("{}_rank_ic_m"),
        "long_rank_ic_ir": f"CASE WHEN direction > 0 THEN {ratio('up_rank_ic')} ELSE {ratio('down_rank_ic')} END", "ndcg": side("{}_ndcg_m"), "coverage": "coverage_m",
        "turnover": side("{}_turnover_m"), "stability": "stability_m", "neutral_rank_ic": "neutral_rank_ic_m", "neutral_rank_ic_ir": f"direction * {ratio('neutral_rank_ic')}", "neutral_win": wins("neutral_rank_ic"),
    }
    rows = ", ".join(f"round(coalesce({e}, 0) + 1.3E-10, 6) + 0.0E0 AS {k}" for k, e in out.items())
    totals = ", ".join(f"{e} AS {k}" for k, e in total_aggregates().items())
    return f"""SELECT direction, rank_ic_n AS days, {rows}, neutral_rank_ic_n AS neutral_days FROM (SELECT *, {d} AS direction FROM (
      SELECT {totals} FROM (SELECT {DATE}, {", ".join(f"{e} AS {k}" for k, e in daily.items())} FROM {{panel}} GROUP BY {DATE}) daily) totals) scored""", cols


@dataclass(frozen=True)
class Neutralised:
    """A neutralised factor (Datetime, Contract, residual) and the controls that were taken out."""

    values: DataFrame
    taken: tuple[str, ...]


class Scorer:
    """Scores columns and programs of one panel against one label. Everything is a column of one plan; a row comes back."""

    def __init__(self, panel: SparkPanel, label: str = "label", config: ScorerConfig = ScorerConfig(), where: str = "TRUE"):
        """``where`` keeps the dates that count; windows still see the dates before them."""
        self.panel, self.label, self.config, self.where = panel, label, config, where

    def _fresh(self) -> SparkPanel:
        return self.panel.anew()

    def factor_values(self, program: Program) -> DataFrame:
        """(Datetime, Contract, factor) of a program on the dates that count."""
        wrong = check(program, self.panel.base.columns)
        if wrong:
            raise ValueError("; ".join(wrong))
        p = self._fresh()
        x = compile_program(p, program, self.config.mask_inputs, self.config.mask_factor)
        return p.frame([x]).where(self.where).select(DATE, NAME, F.col(x).alias("factor"))

    def neutralize_factor(self, factor: str, steps: Sequence[str] | None = None) -> Neutralised:
        """A column without what the steps take out."""
        p, taken = self._fresh(), tuple(self.config.steps if steps is None else steps)
        x = neutralise(p, masks.tradeable_only(p, factor), taken)
        return Neutralised(p.frame([x]).where(self.where).select(DATE, NAME, F.col(x).alias("residual")), taken)

    def score_factor(self, factor: str) -> FactorScore:
        return self._score([lambda p: factor])[0]

    def score_program(self, program: Program) -> FactorScore:
        return self.score_programs([program])[0]

    def score_programs(self, programs: Sequence[Program], batch: int = 8) -> list[FactorScore]:
        """Scores of programs, a plan per batch of them; one that isn't valid scores as nothing known."""
        out = [EMPTY] * len(programs)
        good = [i for i, g in enumerate(programs) if not check(g, self.panel.base.columns)]
        for k in range(0, len(good), batch):
            part = good[k : k + batch]
            build = [lambda p, g=programs[i]: compile_program(p, g, self.config.mask_inputs, self.config.mask_factor) for i in part]
            for i, s in zip(part, self._score(build), strict=True):
                out[i] = s
        return out

    def _score(self, builders, directions: Sequence[int] | None = None) -> list[FactorScore]:
        """Scores of builders of columns, in one plan. One that can't be planned or run scores as nothing known, with its error, and the rest of its batch is scored again in halves."""
        p, daily, total, cols, texts, out = self._fresh(), [], [], [], [], {}
        for i, build in enumerate(builders):
            try:
                aggs, need = daily_aggregates(p, build(p), self.label, self.config)
            except (ValueError, KeyError) as e:
                out[i] = FactorScore(error=f"{type(e).__name__}: {e}")
                continue
            daily += [F.expr(e).alias(f"{k}{i}") for k, e in aggs.items()]
            total += [F.expr(e).alias(k) for k, e in total_aggregates(str(i)).items()]
            cols += need
            texts += aggs.values()
        if daily:
            try:
                with without_shuffles(p.spark):
                    row = p.frame(list(dict.fromkeys(cols)), p.named([self.where, *texts]), self.where).groupBy(DATE).agg(*daily).agg(*total).first()
            except PySparkException as e:
                if len(builders) == 1:
                    return [FactorScore(error=type(e).__name__)]
                h = len(builders) // 2
                return [s for part, d in ((builders[:h], directions and directions[:h]), (builders[h:], directions and directions[h:])) for s in self._score(part, d)]
            for i in range(len(builders)):
                if i not in out:
                    c = replace(self.config, direction=directions[i]) if directions else self.config
                    out[i] = finish(row, c, str(i))
        return [out[i] for i in range(len(builders))]

    def score_columns(self, builders, batch: int = 8, directions: Sequence[int] | None = None) -> list[FactorScore]:
        """Scores of functions from a panel to a column's name, a plan per batch; ``directions`` are those learnt elsewhere."""
        at = range(0, len(builders), batch)
        return [s for k in at for s in self._score(list(builders[k : k + batch]), directions[k : k + batch] if directions else None)]


def score_factor(panel: SparkPanel, factor: str, label: str = "label", config: ScorerConfig = ScorerConfig(), where: str = "TRUE") -> FactorScore:
    return Scorer(panel, label, config, where).score_factor(factor)


def score_program(panel: SparkPanel, program: Program, label: str = "label", config: ScorerConfig = ScorerConfig(), where: str = "TRUE") -> FactorScore:
    return Scorer(panel, label, config, where).score_program(program)
