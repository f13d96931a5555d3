"""Likelihood profiles of every parameter: standard deviations, correlations, sigma and fixed coefficients.

The deviance (ML) comes from the fit's sums, so a trace needs no Spark job. Along a target the other parameters are
minimised anew, starting from the point before. The signed root of the rise is recorded until it passes the cutoff or the
target meets the end of its range; intervals invert it by a monotone cubic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from varicomp.errors import NumericalError, SpecificationError
from varicomp.functions import distributions as dist
from varicomp.lmm import Fit, minimise
from varicomp.operators import pls
from varicomp.operators.infer import _deviance, _held
from varicomp.plans import optimize

POINTS = 19  # of a side
STEP = 0.4  # wanted rise of the signed root between points
NEAR_ONE = 1 - 1e-6


@dataclass(frozen=True)
class Trace:
    target: str
    estimate: float
    status: str
    values: np.ndarray  # rising
    roots: np.ndarray
    low: float  # range of the target
    high: float

    def interval(self, level: float = 0.95) -> tuple[float, float, str]:
        """Ends and status: ok, boundary (an end of the range), unbounded, or why there is no trace."""
        if self.status != "ok":
            return np.nan, np.nan, self.status
        z, ends, status = dist.norm_ppf((1 + level) / 2), [], "ok"
        for want, end in ((-z, self.low), (z, self.high)):
            if self.roots[0] <= want <= self.roots[-1]:
                ends.append(monotone_cubic(self.roots, self.values, want))
            else:
                ends.append(end)
                status = "boundary" if np.isfinite(end) else "unbounded"
        return ends[0], ends[1], status


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: float) -> float:
    """Cubic Hermite interpolation whose slopes are harmonic means of the secants, so that it rises where the data do."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(d) == 1:
        return float(y[0] + d[0] * (at - x[0]))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = d[1:] * d[:-1] > 0
    inner = np.where(same, (w1 + w2) / (w1 / np.where(same, d[:-1], 1) + w2 / np.where(same, d[1:], 1)), 0.0)
    slope = np.r_[d[0], inner, d[-1]]
    k = int(np.clip(np.searchsorted(x, at, "right") - 1, 0, len(d) - 1))
    t = (at - x[k]) / h[k]
    return float(y[k] * (1 + 2 * t) * (1 - t) ** 2 + h[k] * slope[k] * t * (1 - t) ** 2 + y[k + 1] * t**2 * (3 - 2 * t) + h[k] * slope[k + 1] * t**2 * (t - 1))


def natural(theta: np.ndarray, sigma: float, sizes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviations, then correlations, of each correlated part in turn, and sigma; and 0, 1, 2 for these kinds."""
    values, kinds = [], []
    for factor, parts in zip(pls.factors(theta, sizes), sizes, strict=True):
        cov, o = sigma**2 * factor @ factor.T, 0
        for k in parts:
            part = cov[o : o + k, o : o + k]
            sd = np.sqrt(np.diag(part))
            values += sd.tolist() + [part[i, j] / max(sd[i] * sd[j], 1e-300) for j in range(k) for i in range(j + 1, k)]
            kinds += [0] * k + [1] * (k * (k - 1) // 2)
            o += k
    return np.array([*values, sigma]), np.array([*kinds, 2])


def relative(values: np.ndarray, sizes: list[list[int]]) -> np.ndarray | None:
    """theta of natural values; None unless the correlations are those of some vector."""
    theta, at = [], 0
    for parts in sizes:
        for k in parts:
            sd, r = values[at : at + k], np.eye(k) * (1 + 1e-12)
            at += k
            for j in range(k):
                for i in range(j + 1, k):
                    r[i, j] = r[j, i] = values[at]
                    at += 1
            try:
                root = sd[:, None] * np.linalg.cholesky(r) / values[-1]
            except np.linalg.LinAlgError:
                return None
            theta += [root[i, j] for j in range(k) for i in range(j, k)]
    return np.array(theta)


def correlated_pairs(sizes: list[list[int]]) -> dict[int, tuple[int, int]]:
    """Of each correlation in natural(): the places of its two standard deviations."""
    found, at = {}, 0
    for k in (k for parts in sizes for k in parts):
        pairs = [(at + i, at + j) for j in range(k) for i in range(j + 1, k)]
        found |= dict(enumerate(pairs, at + k))
        at += k + len(pairs)
    return found


def _free(values: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The scale of the search: correlations by atanh, sigma by its logarithm."""
    return np.where(kinds == 1, np.arctanh(np.clip(values, -NEAR_ONE, NEAR_ONE)), np.where(kinds == 2, np.log(np.maximum(values, 1e-300)), values))


def _trace(target: str, estimate: float, first: float, low: float, high: float, cutoff: float, least: float, rise: Callable[[float, bool], float]) -> Trace:
    """rise(value, restart): the minimal deviance with the target held."""
    values, roots = [estimate], [0.0]
    for side in (-1, 1):
        value, root, step, restart = estimate, 0.0, first, True
        for _ in range(POINTS):
            nxt = min(max(value + side * step, low), high)
            if nxt == value:
                break
            up = rise(nxt, restart) - least
            restart = False
            if up < -1e-5 * (1 + abs(least) * 1e-6):
                return Trace(target, estimate, "lower_baseline", np.array(values), np.array(roots), low, high)
            new = side * float(np.sqrt(max(up, 0)))
            change = abs(new - root)
            value, root = nxt, new
            values.append(value), roots.append(root)
            if abs(root) >= cutoff:
                break
            step *= float(np.clip(STEP / max(change, 1e-12), 0.25, 10))
    order = np.argsort(values)
    v, r = np.array(values)[order], np.array(roots)[order]
    if (np.diff(r) < -1e-6).any():
        return Trace(target, estimate, "nonmonotone", v, r, low, high)
    rising = np.r_[True, np.diff(np.maximum.accumulate(r)) > 1e-10]
    return Trace(target, estimate, "ok" if rising.sum() > 1 else "flat", v[rising], r[rising], low, high)


def likelihood_profile(fit: Fit, targets: list[str] | None = None) -> list[Trace]:
    """Traces of the targets: `.sig01`, `.sig02`, ... in the order of natural(), `.sigma`, and names of fixed coefficients."""
    ml, _ = minimise(fit.stats, False)
    base, sizes = replace(fit, reml=False, point=ml), fit.stats.sizes
    values, kinds = natural(ml.theta, ml.sigma, sizes)
    names = [f".sig{k + 1:02d}" for k in range(len(kinds) - 1)] + [".sigma"]
    fixed = [fit.names[k] for k in fit.kept]
    unknown = set(targets or []) - {*names, *fixed}
    if unknown:
        raise SpecificationError(f"no such parameters: {sorted(unknown)}")
    cutoff = float(np.sqrt(dist.quantile(lambda x: dist.chi2_sf(x, len(names) + len(fixed)), 0.01)))
    centre, pairs = _free(values, kinds), correlated_pairs(sizes)
    lower = np.where(kinds == 0, 0.0, -np.inf)

    def deviance(x: np.ndarray) -> float:
        full = np.where(kinds == 1, np.tanh(x), np.where(kinds == 2, np.exp(np.minimum(x, 300)), x))
        theta = relative(full, sizes)
        if theta is None:
            return 1e100
        try:
            found = _deviance(base, np.r_[theta, full[-1]])
        except NumericalError:
            return 1e100
        return found if np.isfinite(found) else 1e100

    def least_with(fixed_at: dict[int, float], start: np.ndarray, steps: tuple[float, ...]) -> np.ndarray:
        rest = np.array([k not in fixed_at for k in range(len(kinds))])

        def whole(r: np.ndarray) -> np.ndarray:
            x = np.empty(len(kinds))
            x[rest], x[list(fixed_at)] = r, list(fixed_at.values())
            return x

        return whole(optimize.vector(lambda r: deviance(whole(r)), np.maximum(start, lower)[rest], lower[rest], steps))

    def of_variance(i: int) -> Callable[[float, bool], float]:
        near = [centre]
        # without either standard deviation of a pair its correlation does not matter, so the rise is never more than that
        cap = min((deviance(least_with({i: 0.0, k: 0.0}, centre, (0.5, 0.05))) for k in pairs.get(i, ())), default=np.inf)

        def rise(value: float, restart: bool) -> float:
            held = float(_free(np.array([value]), kinds[[i]])[0])
            near[0] = least_with({i: held}, centre if restart else near[0], (0.1,))
            return min(deviance(near[0]), cap)

        return rise

    def of_coefficient(j: int) -> Callable[[float, bool], float]:
        return lambda value, restart: minimise(_held(fit, j, value), False)[0].objective

    out = []
    for target in targets or [*names, *fixed]:
        if target in names:
            i = names.index(target)
            low, high = {0: (0.0, np.inf), 1: (-NEAR_ONE, NEAR_ONE), 2: (1e-6 * values[-1], np.inf)}[int(kinds[i])]
            first = 0.05 if kinds[i] == 1 else 0.05 * max(1.0, abs(values[i]))
            out.append(_trace(target, float(values[i]), first, low, high, cutoff, ml.objective, of_variance(i)))
        elif len(fixed) == 1:
            out.append(Trace(target, float(ml.beta[0]), "only_coefficient", np.zeros(0), np.zeros(0), -np.inf, np.inf))
        else:
            j = fixed.index(target)
            first = STEP * float(np.sqrt(ml.vcov[j, j]))
            out.append(_trace(target, float(ml.beta[j]), first, -np.inf, np.inf, cutoff, ml.objective, of_coefficient(j)))
    return out


def intervals(spark: SparkSession, traces: list[Trace], level: float = 0.95, scale: str = "sdcor") -> DataFrame:
    """target, estimate, lower, upper, status; with scale varcov standard deviations and sigma are squared."""
    if scale not in ("sdcor", "varcov"):
        raise SpecificationError("scale is sdcor or varcov")
    rows = []
    for t in traces:
        lo, hi, status = t.interval(level)
        squared = scale == "varcov" and t.target.startswith(".sig") and t.low >= 0
        rows.append((t.target, *[float(v * v if squared else v) for v in (t.estimate, lo, hi)], status))
    return spark.createDataFrame(rows, "target string, estimate double, lower double, upper double, status string")


def points(spark: SparkSession, traces: list[Trace]) -> DataFrame:
    """target, value, root: the traces."""
    rows = [(t.target, float(v), float(r)) for t in traces for v, r in zip(t.values, t.roots, strict=True)]
    return spark.createDataFrame(rows, "target string, value double, root double")
