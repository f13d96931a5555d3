"""Inference after a fit: contrasts, Satterthwaite, Kenward-Roger, profile intervals, cluster-robust covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicomp.errors import SpecificationError
from varicomp.functions import distributions as dist
from varicomp.lmm import Fit, minimise
from varicomp.operators import frame as frames
from varicomp.operators import pls, stats


@dataclass(frozen=True)
class Test:
    status: str
    estimate: np.ndarray
    std_error: np.ndarray
    statistic: float
    df1: float
    df2: float
    p_value: float


def _reduced(fit: Fit, contrast) -> np.ndarray | None:
    if not fit.stats.a.size:
        raise SpecificationError("a model that was loaded for prediction holds no sums for inference")
    c = np.atleast_2d(np.asarray(contrast, float))
    return c[:, fit.kept] if all(fit.is_estimable(r) for r in c) else None


def _spectral(c: np.ndarray, est: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Independent directions of a joint hypothesis: values over standard errors, their rows, and the rank."""
    d, p = np.linalg.eigh(v)
    keep = d > np.sqrt(np.finfo(float).eps) * max(d.max(), 1e-300)
    return (p.T @ est)[keep] / np.sqrt(d[keep]), (p.T @ c)[keep], int(keep.sum())


def _independent(l: np.ndarray, rhs) -> tuple[np.ndarray, np.ndarray] | None:
    """As many rows as the hypothesis has rank, with the same meaning; None if rows contradict each other."""
    rhs = np.broadcast_to(np.asarray(rhs, float), (len(l),))
    if len(l) == 1:
        return l, rhs
    u, d, vt = np.linalg.svd(l, full_matrices=False)
    rank = int((d > 1e-10 * max(float(d.max(initial=0)), 1e-300)).sum())
    if rank == len(l):
        return l, rhs
    inside = u[:, :rank].T @ rhs
    if np.abs(u[:, :rank] @ inside - rhs).max() > 1e-8 * max(1.0, float(np.abs(rhs).max())):
        return None
    return vt[:rank] * d[:rank, None], inside


def _refused(status: str) -> Test:
    return Test(status, *[np.array([np.nan])] * 2, *[np.nan] * 4)


def contrast(fit: Fit, c, rhs=0.0) -> Test:
    """Wald test: z for one row, chi-squared for several."""
    l = _reduced(fit, c)
    if l is None:
        return _refused("not_estimable")
    if (same := _independent(l, rhs)) is None:
        return _refused("inconsistent")
    l, rhs = same
    est = l @ fit.beta - rhs
    v = l @ fit.vcov @ l.T
    se = np.sqrt(np.diag(v))
    if len(l) == 1:
        z = float(est[0] / se[0])
        return Test("ok", est, se, z, 1, np.inf, 2 * dist.norm_sf(abs(z)))
    t, _, q = _spectral(l, est, v)
    x = float(t @ t)
    return Test("ok", est, se, x, q, np.inf, dist.chi2_sf(x, q))


@dataclass(frozen=True)
class Satterthwaite:
    """Asymptotic covariance of (theta, sigma), and the derivatives of the fixed effects' covariance by them."""

    fit: Fit
    status: str
    hessian: np.ndarray | None = None
    jacobian: np.ndarray | None = None

    @property
    def a(self) -> np.ndarray:
        return 2 * np.linalg.inv(self.hessian)

    def df(self, l: np.ndarray) -> float:
        g = np.array([l @ j @ l for j in self.jacobian])
        return float(2 * (l @ self.fit.vcov @ l) ** 2 / (g @ self.a @ g))

    def test(self, c, rhs=0.0) -> Test:
        l = _reduced(self.fit, c)
        if self.status != "ok" or l is None:
            return _refused(self.status if l is not None else "not_estimable")
        if (same := _independent(l, rhs)) is None:
            return _refused("inconsistent")
        l, rhs = same
        est, v = l @ self.fit.beta - rhs, l @ self.fit.vcov @ l.T
        se = np.sqrt(np.diag(v))
        if len(l) == 1:
            nu, t = self.df(l[0]), float(est[0] / se[0])
            return Test("ok", est, se, t, 1, nu, 2 * dist.t_sf(abs(t), nu))
        t, rows, q = _spectral(l, est, v)
        nus = np.array([self.df(r) for r in rows])
        if np.ptp(nus) < 1e-8 * nus.max():
            nu = float(nus.mean())
        elif (nus <= 2).any():
            nu = 2.0
        else:
            e = float((nus / (nus - 2)).sum())
            nu = 2 * e / (e - q)
        f = float(t @ t) / q
        return Test("ok", est, se, f, q, nu, dist.f_sf(f, q, nu))


def _deviance(fit: Fit, eta: np.ndarray) -> float:
    """Not profiled over sigma, the last of eta."""
    p = pls.evaluate(fit.stats, eta[:-1], fit.reml)
    nu = fit.stats.n - fit.stats.p * fit.reml
    return p.log_c - fit.stats.log_w + (p.log_s if fit.reml else 0) + nu * np.log(2 * np.pi * eta[-1] ** 2) + p.pwrss / eta[-1] ** 2


def satterthwaite(fit: Fit) -> Satterthwaite:
    """Central differences at two steps, extrapolated; the stencil is evaluated on the driver from the fit's sums."""
    _reduced(fit, np.zeros(len(fit.names)))  # refuses a fit without sums
    if fit.boundary:
        return Satterthwaite(fit, "boundary")
    eta = np.r_[fit.theta, fit.sigma]
    n = len(eta)
    low = np.r_[pls.lower_bounds(fit.stats.sizes), 0]
    step = 1e-4 * np.maximum(1, np.abs(eta))
    step = np.where(low == 0, np.minimum(step, 0.25 * eta), step)

    def derivatives(h):
        e, f0 = np.eye(n) * h, _deviance(fit, eta)
        hess, jac = np.zeros((n, n)), []
        for i in range(n):
            hess[i, i] = (_deviance(fit, eta + e[i]) - 2 * f0 + _deviance(fit, eta - e[i])) / h[i] ** 2
            for j in range(i):
                hess[i, j] = hess[j, i] = (_deviance(fit, eta + e[i] + e[j]) - _deviance(fit, eta + e[i] - e[j]) - _deviance(fit, eta - e[i] + e[j]) + _deviance(fit, eta - e[i] - e[j])) / (4 * h[i] * h[j])
        v = lambda x: x[-1] ** 2 * pls.evaluate(fit.stats, x[:-1], fit.reml).s_inv
        jac = [(v(eta + e[i]) - v(eta - e[i])) / (2 * h[i]) for i in range(n)]
        return hess, np.array(jac)

    (h1, j1), (h2, j2) = derivatives(step), derivatives(step / 2)
    hess, jac = h2 + (h2 - h1) / 3, j2 + (j2 - j1) / 3
    scale = np.sqrt(np.abs(np.outer(np.diag(h2), np.diag(h2))))
    if float((np.abs(hess - h2) / scale).max()) > 5e-3:
        return Satterthwaite(fit, "unstable_derivatives")
    d = np.linalg.eigvalsh(hess)
    if d.min() <= 0:
        return Satterthwaite(fit, "negative_curvature")
    if d.max() / d.min() > 1e12:
        return Satterthwaite(fit, "ill_conditioned")
    return Satterthwaite(fit, "ok", hess, jac)


@dataclass(frozen=True)
class KenwardRoger:
    fit: Fit
    status: str
    adjusted: np.ndarray | None = None
    p: list[np.ndarray] | None = None
    w: np.ndarray | None = None

    def test(self, c, rhs=0.0) -> Test:
        l = _reduced(self.fit, c)
        if self.status != "ok" or l is None:
            return _refused(self.status if l is not None else "not_estimable")
        if (same := _independent(l, rhs)) is None:
            return _refused("inconsistent")
        l, rhs = same
        phi, q, n = self.fit.vcov, len(l), len(self.p)
        h = l.T @ np.linalg.solve(l @ phi @ l.T, l)
        tr = [float(np.trace(h @ phi @ p @ phi)) for p in self.p]
        a1 = sum(self.w[i, j] * tr[i] * tr[j] for i in range(n) for j in range(n))
        a2 = sum(self.w[i, j] * float(np.trace(h @ phi @ self.p[i] @ phi @ h @ phi @ self.p[j] @ phi)) for i in range(n) for j in range(n))
        b = (a1 + 6 * a2) / (2 * q)
        g = ((q + 1) * a1 - (q + 4) * a2) / ((q + 2) * a2)
        den = 3 * q + 2 * (1 - g)
        c1, c2, c3 = g / den, (q - g) / den, (q + 2 - g) / den
        v0, v1, v2 = 1 + c1 * b, 1 - c2 * b, 1 - c3 * b
        v0 = 0.0 if abs(v0) < 1e-10 else v0
        rho = ((1 - a2 / q) / v1) ** 2 * v0 / (q * v2)
        nu = 4 + (q + 2) / (q * rho - 1)
        lam = 1.0 if abs(nu - 2) < 1e-2 else nu * (1 - a2 / q) / (nu - 2)
        est, va = l @ self.fit.beta - rhs, l @ self.adjusted @ l.T
        f = lam * float(est @ np.linalg.solve(va, est)) / q
        return Test("ok", est, np.sqrt(np.diag(va)), f, q, nu, dist.f_sf(f, q, nu))


def kenward_roger(fit: Fit) -> KenwardRoger:
    """From group sums, so without a limit on rows; one grouping factor and no weights. An ML fit is made a REML one."""
    _reduced(fit, np.zeros(len(fit.names)))
    if fit.weights or len(fit.stats.order) > 1:
        return KenwardRoger(fit, "unsupported")
    if not fit.reml:
        point, n = minimise(fit.stats, True)
        fit = replace(fit, reml=True, point=point, evaluations=n)
    if fit.boundary:
        return KenwardRoger(fit, "boundary")
    s, sig2 = fit.stats, fit.sigma**2
    (lam,) = pls.factors(fit.theta, s.sizes)
    a, b, k = s.a, s.m, s.a.shape[1]
    kk = lam @ np.linalg.inv(np.eye(k) + lam.T @ a @ lam) @ lam.T
    power = [kk]
    for _ in range(2):
        power.append(kk + power[-1] - kk @ a @ power[-1])
    fc = np.eye(k) - a @ kk
    zz = {1: fc @ a / sig2, 2: fc @ fc @ a / sig2**2}
    zx = {1: fc @ b / sig2, 2: fc @ fc @ b / sig2**2}
    xx = lambda q: (s.rr - np.einsum("gki,gkl,glj->ij", b, power[q - 1], b)) / sig2**q
    basis, o = [], 0
    for part in s.sizes[0]:
        for j in range(part):
            for i in range(j, part):
                e = np.zeros((k, k))
                e[o + i, o + j] = e[o + j, o + i] = 1
                basis.append(e)
        o += part
    sandwich = lambda x, m, y: np.einsum("gki,gkl,glj->ij", x, m, y)
    one = lambda e: np.broadcast_to(e, (len(a), k, k))
    ps = [-sandwich(zx[1], one(e), zx[1]) for e in basis] + [-xx(2)]
    n = len(basis) + 1
    q, tr = [[None] * n for _ in range(n)], np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            if i < n - 1 and j < n - 1:
                q[i][j] = sandwich(zx[1], basis[i] @ zz[1] @ basis[j], zx[1])
                tr[i, j] = float(np.einsum("gkl,glk->", basis[i] @ zz[1], basis[j] @ zz[1]))
            elif i == j:
                q[i][j] = xx(3)
                tr[i, j] = (s.n - float(np.einsum("gkl,glk->", power[1], a))) / sig2**2
            else:
                e = basis[min(i, j)]
                v = sandwich(zx[1], one(e), zx[2])
                q[i][j] = v if i < j else v.T
                tr[i, j] = float(np.einsum("kl,glk->", e, zz[2]))
    phi = fit.vcov
    info = np.array([[tr[i, j] - 2 * np.trace(phi @ q[i][j]) + np.trace(phi @ ps[i] @ phi @ ps[j]) for j in range(n)] for i in range(n)])
    d = np.abs(np.linalg.eigvalsh(info))
    if d.min() <= 1e-10:
        return KenwardRoger(fit, "singular_information")
    if d.max() / d.min() > 1e12:
        return KenwardRoger(fit, "ill_conditioned")
    w = 2 * np.linalg.inv(info)
    inner = sum(w[i, j] * (q[i][j] - ps[i] @ phi @ ps[j]) for i in range(n) for j in range(n))
    adjusted = phi + 2 * phi @ inner @ phi
    return KenwardRoger(fit, "ok", (adjusted + adjusted.T) / 2, ps, w)


def _held(fit: Fit, j: int, value: float):
    """The sums when coefficient j (of the kept) is held: its column goes to the offset, by algebra only."""
    s = fit.stats
    v, c = value - (s.shift if j == 0 else 0.0), s.q2 + j
    rest = np.delete(np.arange(s.q2 + s.p), c)
    return replace(s, m=s.m[:, :, rest], f=s.f - v * s.m[:, :, c], rr=s.rr[np.ix_(rest, rest)], rf=(s.rf - v * s.rr[:, c])[rest], yy=s.yy - 2 * v * s.rf[c] + v * v * s.rr[c, c], p=s.p - 1)


def profile_interval(fit: Fit, target: str, level: float = 0.95) -> tuple[float, float]:
    """Likelihood interval of a fixed coefficient, `.sigma`, or `.sig01` (one random intercept); ML, by bisection on the deviance."""
    ml, _ = minimise(fit.stats, False)
    z2 = dist.norm_ppf((1 + level) / 2) ** 2
    base = replace(fit, reml=False, point=ml)
    if target in (".sigma", ".sig01"):
        if len(ml.theta) != 1:
            raise SpecificationError("variance targets need one random intercept")
        from varicomp.plans.optimize import scalar

        centre = ml.sigma if target == ".sigma" else ml.sigma * float(ml.theta[0])
        f = (lambda v: _deviance(base, np.array([t := scalar(lambda t: _deviance(base, np.array([t, v]))), v])) + 0 * t) if target == ".sigma" else (lambda v: min(_deviance(base, np.array([v / s, s])) for s in ml.sigma * np.exp(np.linspace(-1, 1, 801))))
        spread = 0.05 * max(centre, 1e-3)
    else:
        j = [fit.names[k] for k in fit.kept].index(target)
        centre, spread = float(ml.beta[j]), float(np.sqrt(ml.vcov[j, j]))

        def f(v: float) -> float:
            held = _held(fit, j, v)
            if held.p == 0:
                raise SpecificationError("the only fixed coefficient cannot be held")
            return minimise(held, False)[0].objective

    ends = []
    for sign in (-1, 1):
        out = spread
        while f(max(centre + sign * out, 1e-12 if target.startswith(".") else -np.inf)) - ml.objective < z2:
            out *= 2
            if target.startswith(".") and sign < 0 and centre - out <= 0:
                out = centre
                break
            if out > 1e8 * spread:
                break
        lo, hi = 0.0, out
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(max(centre + sign * mid, 1e-12 if target.startswith(".") else -np.inf)) - ml.objective < z2 else (lo, mid)
        ends.append(centre + sign * hi)
    return ends[0], ends[1]


@dataclass(frozen=True)
class ClusterRobust:
    fit: Fit
    kind: str
    meat: np.ndarray  # (p, p), the sum over clusters of products of scores
    clusters: int
    blocks: DataFrame | None = None  # of CR2: score, ex and ete of each cluster, on executors

    @cached_property
    def _fetched(self) -> list[np.ndarray]:
        p = len(self.meat)
        rows = self.blocks.select("ex", "ete").collect()
        return [np.array([r[k] for r in rows]).reshape(-1, p, p) for k in range(2)]

    @property
    def ex(self) -> np.ndarray:
        """Of all clusters, on the driver; no test needs them there."""
        return self._fetched[0]

    @property
    def ete(self) -> np.ndarray:
        return self._fetched[1]

    @property
    def vcov(self) -> np.ndarray:
        b = self.fit.point.s_inv
        return b @ self.meat @ b

    def test(self, c, rhs=0.0) -> Test:
        """One row: t with Satterthwaite's degrees of freedom for CR2, else normal. Several: HTZ F for CR2, else chi-squared."""
        l = _reduced(self.fit, c)
        if l is None:
            return Test("not_estimable", *[np.array([np.nan])] * 2, *[np.nan] * 4)
        est, v, q = l @ self.fit.beta - rhs, l @ self.vcov @ l.T, len(l)
        se = np.sqrt(np.diag(v))
        if np.linalg.matrix_rank(l) < q:
            raise SpecificationError("the rows of a joint hypothesis must be independent")
        if q > self.clusters:
            return Test("rank_deficient", est, se, *[np.nan] * 4)
        if q == 1:
            nu = self._htz(l) if self.kind == "CR2" else np.inf
            t = float(est[0] / se[0])
            return Test("ok", est, se, t, 1, nu, 2 * dist.t_sf(abs(t), nu))
        wald = float(est @ np.linalg.solve(v, est))
        if self.kind != "CR2":
            return Test("ok", est, se, wald, q, np.inf, dist.chi2_sf(wald, q))
        eta = self._htz(l)
        if eta <= q - 1:
            return Test("no_degrees_of_freedom", est, se, *[np.nan] * 4)
        f = (eta - q + 1) / eta * wald / q
        return Test("ok", est, se, f, q, eta - q + 1, dist.f_sf(f, q, eta - q + 1))

    def _htz(self, l: np.ndarray) -> float:
        """Degrees of freedom of the Wishart matrix that has the covariance estimate's mean and total variance; for one row, Satterthwaite's.

        The covariance of two clusters' parts is minus the product of their h, and e more within one cluster. So what sums
        over pairs of clusters is a product of sums over clusters, and these are made where the clusters are.
        """
        b, q, p = self.fit.point.s_inv, len(l), len(self.meat)
        lb, root_b = l @ b, np.linalg.cholesky(b)

        def cells(batch: pa.RecordBatch) -> np.ndarray:
            ex, ete = (_wide(batch.column(name)).reshape(-1, p, p) for name in ("ex", "ete"))
            h, e = np.einsum("sp,cpk,kr->csr", lb, ex, root_b), np.einsum("sp,cpr,tr->cst", lb, ete, lb)
            hh = np.einsum("csk,ctk->cst", h, h)
            return np.concatenate([e.sum(axis=0).ravel(), np.einsum("csk,ctl->stkl", h, h).ravel(), *(np.einsum("cst,cuv->stuv", e, x).ravel() for x in (e, hh))])

        sums = stats.added(self.blocks.select("ex", "ete"), cells)
        e, gram, ee, eh = np.split(sums, np.cumsum([q * q, q * q * p * p, q**4]))
        gram, ee, eh = gram.reshape(q, q, p, p), ee.reshape([q] * 4), eh.reshape([q] * 4)
        d, u = np.linalg.eigh(e.reshape(q, q) - np.einsum("stkk->st", gram))
        root = (u / np.sqrt(d)) @ u.T
        gram = np.einsum("us,vt,stkl->uvkl", root, root, gram)
        ee, eh = (np.einsum("as,bt,cu,dv,stuv->abcd", root, root, root, root, x) for x in (ee, eh))
        total = np.einsum("stkl,stlk->", gram, gram) + np.einsum("stkl,stkl->", gram, gram)
        total += sum(np.einsum(f"{at}->", ee - 2 * eh) for at in ("stst", "sstt"))
        return float(q * (q + 1) / total)


def _wide(column: pa.ListArray) -> np.ndarray:
    """A column of lists of one length, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nested(rows: DataFrame, group: str, cluster: str) -> bool:
    """Whether each group lies in one cluster."""
    return rows.groupBy(group).agg(F.countDistinct(cluster).alias("n")).where("n > 1").limit(1).count() == 0


def cluster_robust(fit: Fit, cluster: str | None = None, kind: str = "CR1") -> ClusterRobust:
    """cluster: a column that the (one) grouping factor nests in; by default the factor itself."""
    if fit.weights or len(fit.stats.order) > 1:
        raise SpecificationError("one grouping factor and no weights are supported")
    x = [f"__x{k}" for k in fit.kept]
    k = fit.stats.a.shape[1]
    z = [f"__z0_{j}" for j in range(k)]
    rows = fit.frame.rows
    if cluster:
        kept = fit.frame.status.where("__status = 'retained'")
        group = frames.group_label(fit.formula.random[0].group)
        if not nested(kept.withColumn("__group", group), "__group", f"`{cluster}`"):
            raise SpecificationError("a group lies in several clusters")
        owner = kept.select(group.alias("__g0"), F.col(f"`{cluster}`").cast("string").alias("__cluster")).distinct()
        rows = rows.join(owner, "__g0")
    else:
        rows = rows.withColumn("__cluster", F.col("__g0"))
    e = F.col("__y") - F.col("__o") - sum([F.lit(float(b)) * F.col(c) for b, c in zip(fit.beta, x, strict=True)])
    rows = rows.withColumn("__e", e)
    (lam,) = pls.factors(fit.theta, fit.stats.sizes)
    if kind in ("CR0", "CR1"):
        sums = rows.groupBy("__cluster", "__g0").agg(*[F.sum(F.col(c) * F.col("__e")).alias(c) for c in [*x, *z]]).toPandas().sort_values("__g0")
        kk = lam @ np.linalg.inv(np.eye(k) + lam.T @ fit.stats.a @ lam) @ lam.T
        scores = sums[x].to_numpy() - np.einsum("gki,gkl,gl->gi", fit.stats.m, kk, sums[z].to_numpy())
        found = pd.DataFrame(scores).groupby(sums["__cluster"].to_numpy()).sum().to_numpy()
        n = len(found)
        if n < 2:
            raise SpecificationError("two clusters are needed")
        return ClusterRobust(fit, kind, found.T @ found * (n / (n - 1) if kind == "CR1" else 1.0), n)
    if kind != "CR2":
        raise SpecificationError("kind is CR0, CR1 or CR2")
    p, b, tt = len(x), fit.point.s_inv, lam @ lam.T

    def stacked(e: np.ndarray, xs: np.ndarray, zs: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """score, ex and ete of clusters with the same number of rows, the first axis by cluster."""
        turned = lambda m: np.swapaxes(m, 1, 2)
        t = np.eye(e.shape[1]) + (zs @ tt @ turned(zs)) * (g[:, :, None] == g[:, None, :])
        r = turned(np.linalg.cholesky(t))
        d, q = np.linalg.eigh(r @ (t - xs @ b @ turned(xs)) @ turned(r))
        scale = np.where(d > 1e-12, np.maximum(d, 1e-300) ** -0.5, 0)
        ec = turned(np.linalg.solve(t, xs)) @ turned(r) @ (q * scale[:, None, :]) @ turned(q) @ r
        return (ec @ e[:, :, None])[:, :, 0], ec @ xs, ec @ t @ turned(ec)

    def whole(rows: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        e, xs, zs = rows["__e"].to_numpy(), *(np.column_stack([rows[c].to_numpy() for c in names]) for names in (x, z))
        g, length = stats.codes(rows["__g0"]), np.diff(np.r_[start, len(rows)])
        for n in np.unique(length):
            same = start[length == n]
            for part in np.array_split(same, -(-len(same) * n * n // 1_000_000)):
                at = part[:, None] + np.arange(n)
                found = [v.reshape(len(part), -1) for v in stacked(e[at], xs[at], zs[at], g[at])]
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64())) for v in found], names=["score", "ex", "ete"])

    def by_cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cluster; those of the last cluster wait for the next batch."""
        rest = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*rest, batch])
            code = stats.codes(rows["__cluster"])
            start = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1]
            if len(start) > 1:
                yield from whole(rows.slice(0, start[-1]), start[:-1])
            rest = rows.slice(start[-1]).to_batches()
        if rest:
            yield from whole(pa.Table.from_batches(rest), np.array([0]))

    sorted_rows = rows.select("__cluster", "__g0", "__e", *x, *z).repartition("__cluster").sortWithinPartitions("__cluster")
    blocks = sorted_rows.mapInArrow(by_cluster, "score array<double>, ex array<double>, ete array<double>").persist(StorageLevel.MEMORY_AND_DISK)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        score = _wide(batch.column("score"))
        return np.r_[len(score), (score.T @ score).ravel()]

    found = stats.added(blocks.select("score"), products)
    return ClusterRobust(fit, kind, found[1:].reshape(p, p), int(found[0]), blocks)


def performance(fit: Fit, data: DataFrame) -> DataFrame:
    """Variance of the fixed predictor, mean random and residual variances, marginal and conditional R2, ICC."""
    rows = fit.frame.rows
    fixed = sum([F.lit(float(b)) * F.col(f"__x{k}") for k, b in zip(fit.kept, fit.beta, strict=True)])
    random = F.lit(0.0)
    for k, t in enumerate(fit.stats.order):
        g = fit.covariances[k]
        for i in range(len(g)):
            for j in range(len(g)):
                random = random + F.lit(float(g[i, j])) * F.col(f"__z{t}_{i}") * F.col(f"__z{t}_{j}")
    one = rows.agg(F.var_pop(fixed).alias("fixed_variance"), F.avg(random).alias("random_variance"), F.avg(F.lit(fit.sigma**2) / F.col("__w")).alias("residual_variance"), F.count("*").alias("nobs"))
    total = F.col("fixed_variance") + F.col("random_variance") + F.col("residual_variance")
    return one.select("*", (F.col("fixed_variance") / total).alias("r2_marginal"), ((F.col("fixed_variance") + F.col("random_variance")) / total).alias("r2_conditional"), (F.col("random_variance") / (F.col("random_variance") + F.col("residual_variance"))).alias("icc"))
