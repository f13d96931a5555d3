"""Gaussian linear mixed models: fit, refit, prediction."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varicomp.errors import ConvergenceError, PredictionError, ResourceLimitError, SpecificationError
from varicomp.operators import frame as frames
from varicomp.operators import crossed, pls, stats, tier
from varicomp.operators import rank as ranks
from varicomp.plans import formula as formulas
from varicomp.plans import optimize

#: Levels up to which random effects are sent to every task in a join.
BROADCAST_LEVELS = 100_000


@dataclass(frozen=True)
class Fit:
    formula: formulas.Formula
    encoder: frames.Encoder
    random_encoder: frames.Encoder
    random_names: tuple[tuple[str, ...], ...]
    names: list[str]  # all fixed columns
    kept: list[int]  # those that are estimated
    r: np.ndarray  # R factor of all fixed columns
    stats: stats.Stats | None
    point: pls.Point
    reml: bool
    evaluations: int
    offset: str | None = None
    weights: str | None = None
    frame: frames.Frame | None = None
    subset: str | None = None
    na_action: str = "error"
    converged: bool = True
    message: str = "ok"

    @property
    def beta(self) -> np.ndarray:
        return self.point.beta

    @property
    def full_beta(self) -> np.ndarray:
        out = np.full(len(self.names), np.nan)
        out[self.kept] = self.beta
        return out

    @property
    def sigma(self) -> float:
        return self.point.sigma

    @property
    def theta(self) -> np.ndarray:
        return self.point.theta

    @property
    def vcov(self) -> np.ndarray:
        return self.point.vcov

    @property
    def objective(self) -> float:
        return self.point.objective

    @property
    def covariances(self) -> list[np.ndarray]:
        """G of each term, largest first."""
        return [self.sigma**2 * t @ t.T for t in pls.factors(self.theta, self.stats.sizes)]

    @property
    def boundary(self) -> bool:
        return bool((self.theta[pls.lower_bounds(self.stats.sizes) == 0] == 0).any())

    @cached_property
    def rank(self) -> ranks.Rank:
        return ranks.of(self.r, self.names, self.kept)

    def is_estimable(self, contrast: np.ndarray) -> bool:
        return self.rank.is_estimable(contrast)

    def fixed_effects(self, spark) -> DataFrame:
        se = np.full(len(self.names), np.nan)
        se[self.kept] = np.sqrt(np.diag(self.vcov))
        return spark.createDataFrame([(n, float(b), float(e)) for n, b, e in zip(self.names, self.full_beta, se, strict=True)], "name string, estimate double, std_error double")

    def random_effects(self, spark) -> DataFrame:
        """(term, level, coefficient, u, b) as a table."""
        if isinstance(self.stats, tier.LevelTable):
            names = self.random_names[0]
            each = F.inline(F.array(*[F.struct(F.lit(c).alias("coefficient"), F.col(f"u{j}").alias("u"), F.col(f"b{j}").alias("b")) for j, c in enumerate(names)]))
            return tier.effects(self.stats, self.point).select(F.lit(self.formula.random[0].name).alias("term"), "level", each)
        rows = [(self.formula.random[t].name, lv, c, float(u), float(b)) for k, t in enumerate(self.stats.order) for lv, us, bs in zip(self.stats.labels[k], self.point.u[k], self.point.b[k], strict=True) for c, u, b in zip(self.random_names[t], us, bs, strict=True)]
        return spark.createDataFrame(rows, "term string, level string, coefficient string, u double, b double")

    def predict(self, data: DataFrame, mode: str = "conditional", allow_new_groups: bool = False, offset: str | None = None) -> DataFrame:
        """data with prediction, new_group and estimable. Unknown fixed levels fail the job; an unseen group fails it too,
        or adds nothing and is flagged. A row that no coefficients determine gets NaN."""
        if self.offset and not offset:
            raise PredictionError("the fit has an offset argument, so new data need one")
        cols = self.encoder.columns()
        known = F.when(self.encoder.unknown(), F.raise_error(F.lit("a fixed level was not in the fit"))).otherwise(F.lit(0.0))
        full = np.nan_to_num(self.full_beta)
        fixed = reduce(lambda a, b: a + b, [F.lit(float(full[k])) * cols[k][1] for k in self.kept])
        total = fixed + known + reduce(lambda a, b: a + b, [F.col(f"`{o}`").cast("double") for o in (*self.formula.offsets, *([offset] if offset else []))], F.lit(0.0))
        ok = self.rank.determined([c for _, c in cols])
        out, new = data, F.lit(False)
        if mode == "conditional":
            for k, t in enumerate(self.stats.order):
                term = self.formula.random[t]
                names = self.random_names[t]
                table = self._effects_to_join(data.sparkSession, k, t)
                out = out.withColumn(f"__k{t}", frames.group_label(term.group)).join(table, F.col(f"__k{t}") == F.col(f"__l{t}"), "left")
                z = [F.lit(1.0)] + ([c for _, c in self.random_encoder.variable(term.slope)] if term.slope else [])
                unseen = F.col(f"__l{t}").isNull()
                if not allow_new_groups:
                    unseen = F.when(unseen, F.raise_error(F.lit("a group was not in the fit"))).otherwise(F.lit(False))
                new = new | unseen
                total = total + F.coalesce(reduce(lambda a, b: a + b, [F.col(f"__b{t}_{j}") * c for j, c in enumerate(z)]), F.lit(0.0))
        elif mode != "population":
            raise PredictionError("mode is conditional or population")
        return out.select(*[F.col(f"`{c}`") for c in data.columns], F.when(ok, total).otherwise(float("nan")).alias("prediction"), new.alias("new_group"), ok.alias("estimable"))

    def _effects_to_join(self, spark, k: int, t: int) -> DataFrame:
        """(__l<t>, __b<t>_<j>): the effects of each level; broadcast only if the levels are few."""
        if isinstance(self.stats, tier.LevelTable):
            n = self.stats.levels
            table = tier.effects(self.stats, self.point).select(F.col("level").alias(f"__l{t}"), *[F.col(f"b{j}").alias(f"__b{t}_{j}") for j in range(self.stats.k)])
        else:
            n = len(self.stats.labels[k])
            table = spark.createDataFrame([(lv, *map(float, b)) for lv, b in zip(self.stats.labels[k], self.point.b[k], strict=True)], ", ".join([f"__l{t} string", *[f"__b{t}_{j} double" for j in range(len(self.random_names[t]))]]))
        return F.broadcast(table) if n <= BROADCAST_LEVELS else table

    def with_residuals(self, data: DataFrame) -> DataFrame:
        """data with fitted and residual, for rows that the fit kept."""
        out = self.predict(data, offset=self.offset)
        return out.withColumnRenamed("prediction", "fitted").withColumn("residual", F.col(f"`{self.formula.response}`").cast("double") - F.col("fitted")).drop("new_group", "estimable")


@dataclass(frozen=True)
class FitControl:
    """How hard a fit tries: most evaluations of the objective, the gain that is not worth a step, and what to do if neither helps."""

    most_evaluations: int = 20_000
    gain: float = 1e-2
    on_failure: str = "error"  # or "warn": the fit says so in `converged` and `message`

    def __post_init__(self):
        if self.most_evaluations < 1 or not self.gain > 0 or self.on_failure not in ("error", "warn"):
            raise SpecificationError("most_evaluations and gain must be positive; on_failure is error or warn")


def diagnose(s: stats.Stats, point: pls.Point, reml: bool, control: FitControl) -> str:
    """ok, or why the point is no minimum: by how much a Newton step in one parameter would lower the objective."""
    low, f = pls.lower_bounds(s.sizes), lambda theta: pls.evaluate(s, theta, reml).objective
    slopes = pls.with_gradient(s, point.theta, reml).gradient
    for k in range(len(low)):
        h = np.zeros(len(low))
        h[k] = 1e-4 * max(1.0, abs(point.theta[k]))
        if low[k] == 0 and point.theta[k] < h[k]:  # at the bound only a fall counts
            gain = point.objective - f(point.theta + h)
        else:
            up, down = f(point.theta + h), f(point.theta - h)
            bend = (up - 2 * point.objective + down) / h[k] ** 2
            gain = slopes[k] ** 2 / (2 * bend) if bend > 0 else point.objective - min(up, down)
        if gain > control.gain * (1 + 1e-9 * abs(point.objective)):
            return f"parameter {k} could lower the objective by {gain:.2g}"
    return "ok"


class _OutOfEvaluations(Exception):
    pass


def minimise(s: stats.Stats, reml: bool, most: int = 1_000_000) -> tuple[pls.Point, int]:
    """Minimum over the covariance parameters; no Spark job. With more than `most` evaluations, the best point so far."""
    try:
        return _minimise(s, reml, seen := {}, most)
    except _OutOfEvaluations:
        theta = np.frombuffer(min(seen, key=seen.get), float)
        return pls.evaluate(s, theta.copy(), reml), len(seen)


def _beside(theta: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Points near one with diagonals of 0, where slopes tell nothing: the column below such a one has either sign, and both are tried."""
    out = []
    for k in np.flatnonzero((theta == 0) & (low == 0)):
        end = next((j for j in range(k + 1, len(low)) if low[j] == 0), len(low))
        for h in (0.01, 0.05):
            for sign in (1, -1):
                t = theta.copy()
                t[k] = h
                t[k + 1 : end] *= sign
                out.append(t)
    return out


def _is_minimum(s: stats.Stats, point: pls.Point, reml: bool) -> bool:
    try:
        return diagnose(s, point, reml, FitControl()) == "ok"
    except pls.NumericalError:
        return True  # a step beside it cannot be judged


def _minimise(s: stats.Stats, reml: bool, seen: dict[bytes, float], most: int) -> tuple[pls.Point, int]:
    """Quasi-Newton steps with exact gradients; where these end too early, a search by values alone goes on."""

    def fg(theta: np.ndarray) -> tuple[float, np.ndarray]:
        if len(seen) >= most:
            raise _OutOfEvaluations
        try:
            point = pls.with_gradient(s, theta, reml)
        except pls.NumericalError:
            seen[theta.tobytes()] = 1e100
            return float("inf"), np.zeros(len(theta))
        seen[theta.tobytes()] = point.objective
        return point.objective, point.gradient

    def f(theta) -> float:
        theta = np.atleast_1d(np.asarray(theta, float))
        key = theta.tobytes()
        if key not in seen:
            if len(seen) >= most:
                raise _OutOfEvaluations
            try:
                seen[key] = pls.evaluate(s, theta, reml).objective
            except pls.NumericalError:
                seen[key] = 1e100
        return seen[key]

    low = pls.lower_bounds(s.sizes)
    start = (low == 0).astype(float)
    for _ in range(5):
        theta, settled = optimize.quasi_newton(fg, start, low)
        zero = np.where((low == 0) & (theta <= 1e-4), 0.0, theta)
        if f(zero) <= f(theta) + optimize.rounding(f(theta)):
            theta = zero
        start = min([theta, *_beside(theta, low)], key=f)
        if settled and start is theta and _is_minimum(s, point := pls.evaluate(s, theta, reml), reml):
            return point, len(seen)
    if len(low) == 1:
        theta = optimize.scalar(lambda x: f([x]))
        if theta:
            theta = optimize._newton(f, np.array([theta]), low)
        theta = np.atleast_1d(theta)
    else:
        theta = optimize.vector(f, (low == 0).astype(float), low)
    return pls.evaluate(s, theta, reml), len(seen)


def lmm(df: DataFrame, formula: str, *, reml: bool = True, weights: str | None = None, offset: str | None = None, subset: str | None = None, na_action: str = "error", contrasts: dict | None = None, random_contrasts: dict | None = None, levels: dict | None = None, theta: np.ndarray | None = None, control: FitControl = FitControl(), row_id: str | None = None, sums: str = "auto") -> Fit:
    """Fits by REML or ML. A handful of jobs: levels, R factor, one aggregation for each grouping factor and pair.

    sums: where sums by level are kept, "driver" or "executors"; "auto" leaves those of one factor on executors where they
    are too many for the driver, and those of two crossed or nested random intercepts where their cross block is. There an
    evaluation is a job, and what needs single levels on the driver is refused.
    """
    if sums not in ("auto", "driver", "executors"):
        raise SpecificationError("sums is auto, driver or executors")
    parsed = formulas.parse(formula)
    frame = frames.build(df, parsed, weights, offset, subset, na_action, contrasts, random_contrasts, levels, row_id)
    rows = frame.rows.persist()
    try:
        names = [n for n, _ in frame.encoder.columns()]
        r = stats.r_factor(rows, [f"__x{k}" for k in range(len(names))])
        kept = stats.independent_columns(r)
        sizes = [[len(z)] if t.correlated else [1] * len(z) for z, t in zip(frame.random_names, parsed.random, strict=True)]
        if sums == "executors" and len(sizes) != 1:
            raise SpecificationError("sums of several grouping factors are kept on the driver")
        try:
            found = tier.collect(rows, kept, sizes) if sums == "executors" else stats.collect(rows, kept, sizes)
        except ResourceLimitError:
            if sums == "driver":
                raise
            found = (crossed if len(sizes) > 1 else tier).collect(rows, kept, sizes)
    finally:
        rows.unpersist()
    point, n, message = _point(found, reml, control, theta)
    return Fit(parsed, frame.encoder, frame.random_encoder, frame.random_names, names, kept, r, found, point, reml, n, offset, weights, frame, subset, na_action, message == "ok", message)


def _point(found: stats.Stats, reml: bool, control: FitControl, theta: np.ndarray | None = None) -> tuple[pls.Point, int, str]:
    if isinstance(found, tier.LevelTable):
        if theta is not None:
            return tier.at(found, theta, reml), 1, "ok"
        point, n, message = tier.minimise(found, reml, control.most_evaluations, _beside)
        if message != "ok" and control.on_failure == "error":
            raise ConvergenceError(message)
        return point, n, message
    if theta is not None:
        return pls.evaluate(found, theta, reml), 1, "ok"
    point, n = minimise(found, reml, control.most_evaluations)
    message = f"stopped after {n} evaluations" if n >= control.most_evaluations else diagnose(found, point, reml, control)
    if message != "ok" and control.on_failure == "error":
        raise ConvergenceError(message)
    return point, n, message


def refit(fit: Fit, response: str, df: DataFrame, control: FitControl = FitControl()) -> Fit:
    """The same model, subset and missing-value policy for another response column; covariance parameters are found anew.

    If df has the rows of the fit, only sums that hold the response are made; else all are.
    """
    renamed = replace(fit.formula, response=response)
    frame = frames.build(df, renamed, fit.weights, fit.offset, fit.subset, fit.na_action, fit.encoder.coding, fit.random_encoder.coding, fit.encoder.levels)
    if not isinstance(df.schema[response].dataType, T.NumericType):
        raise SpecificationError("the response must be numeric")
    sizes = [None] * len(fit.stats.order)
    for k, t in enumerate(fit.stats.order):
        sizes[t] = fit.stats.sizes[k]
    if isinstance(fit.stats, tier.LevelTable):
        found = (crossed if len(sizes) > 1 else tier).collect(frame.rows, fit.kept, sizes)
    else:
        found = stats.with_response(fit.stats, frame.rows, fit.kept) if fit.stats.a.size else None
        found = found or stats.collect(frame.rows, fit.kept, sizes)
    point, n, message = _point(found, fit.reml, control)
    return replace(fit, formula=renamed, stats=found, point=point, evaluations=n, frame=frame, converged=message == "ok", message=message)
