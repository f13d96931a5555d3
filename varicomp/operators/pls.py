"""The profiled deviance at given covariance parameters, from sufficient statistics only."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from varicomp.errors import NumericalError, ResourceLimitError, SpecificationError
from varicomp.operators.stats import Stats

MOST_FACTOR_CELLS = 10_000_000  # of a factor that couples levels, which is dense


def n_theta(sizes: list[list[int]]) -> int:
    return sum(k * (k + 1) // 2 for parts in sizes for k in parts)


def lower_bounds(sizes: list[list[int]]) -> np.ndarray:
    """0 for diagonal elements, else unbounded."""
    return np.array([0.0 if i == j else -np.inf for parts in sizes for k in parts for j in range(k) for i in range(j, k)])


def factors(theta: np.ndarray, sizes: list[list[int]]) -> list[np.ndarray]:
    """For each term the lower-triangular relative factor, filled column by column within each correlated part."""
    out, at = [], 0
    for parts in sizes:
        t, o = np.zeros((sum(parts),) * 2), 0
        for k in parts:
            for j in range(k):
                t[o + j : o + k, o + j] = theta[at : at + k - j]
                at += k - j
            o += k
        out.append(t)
    if at != len(theta) or any((np.diag(t) < 0).any() for t in out):
        raise NumericalError("theta has the wrong length or a negative diagonal")
    return out


@dataclass
class Point:
    theta: np.ndarray
    objective: float
    beta: np.ndarray
    u: list[np.ndarray]  # by term, (levels, k)
    b: list[np.ndarray]
    pwrss: float
    sigma: float
    log_c: float
    log_s: float
    s_inv: np.ndarray
    wrss: float
    gradient: np.ndarray | None = None

    @property
    def vcov(self) -> np.ndarray:
        return self.sigma**2 * self.s_inv


def _block_sums(s: Stats, c1: np.ndarray, x1: np.ndarray | None, share: np.ndarray | None, rr: np.ndarray, l2: np.ndarray, reml: bool) -> list[np.ndarray]:
    """For each term the sum over its levels of the diagonal blocks of the inverse of the system: of random and fixed
    effects for REML, of random effects for ML. c1, x1 or share, and rr are what the elimination of the first term leaves."""
    q2, p = s.q2, s.p
    n = q2 + p if reml else q2
    sums = [np.linalg.inv(c1).sum(axis=0)]
    if n:
        if q2 == np.count_nonzero(l2.diagonal()) == np.count_nonzero(l2):
            scale = np.r_[l2.diagonal(), np.ones(n - q2)]
            scaled = lambda a: scale[:, None] * a * scale
            across = scaled
        else:
            wide = np.eye(n)
            wide[:q2, :q2] = l2
            scaled, across = (lambda a: wide.T @ a @ wide), (lambda a: wide @ a @ wide.T)
        tail = scaled(rr[:n, :n])
        tail[np.arange(q2), np.arange(q2)] += 1
        inverse = np.linalg.inv(tail)
        h = across(inverse)
        if share is None:
            part = x1[:, :, :n]
            sums[0] += np.einsum("gkc,gjc->kj", part @ h, part)
        else:
            full = np.zeros((q2 + p, q2 + p))
            full[:n, :n] = 2 * h
            full[np.arange(n), np.arange(n)] /= 2  # pairs of different columns are kept once
            sums[0] += float(s.sparse.gram(share**2, q2 + p) @ full.ravel())
    at = 0
    for parts, labels in zip(s.sizes[1:], s.labels[1:], strict=True):
        k = sum(parts)
        block = inverse[at : at + len(labels) * k, at : at + len(labels) * k].reshape(len(labels), k, len(labels), k)
        sums.append(np.einsum("lilj->ij", block))
        at += len(labels) * k
    return sums


def with_gradient(s: Stats, theta: np.ndarray, reml: bool) -> Point:
    """The point and the objective's derivatives by theta; at a diagonal of 0, those just inside the bound.

    With T a term's factor, u its spherical effects and R the sum of its blocks of the inverse system, the derivative by T is
    2 T'^-1 (levels I - R - nu / pwrss sum u u'): the system's own equations replace the products with the rows' sums.
    """
    inside = np.where(lower_bounds(s.sizes) == 0, np.maximum(theta, 1e-5), theta)
    point = evaluate(s, inside, reml, gradient=True)
    return point if np.array_equal(inside, theta) else replace(evaluate(s, theta, reml), gradient=point.gradient)


def evaluate(s: Stats, theta: np.ndarray, reml: bool, gradient: bool = False) -> Point:
    """Eliminates the largest grouping factor level by level, then the others, then the fixed effects."""
    theta = np.asarray(theta, float)
    ls = factors(theta, s.sizes)
    try:
        l1, k = ls[0], s.a.shape[1]
        c1 = np.eye(k) + l1.T @ s.a @ l1
        sparse = s.sparse
        chol = np.linalg.cholesky(c1)
        log_c = 2 * float(np.log(np.diagonal(chol, axis1=1, axis2=2)).sum())
        lf = s.f @ l1
        y1 = np.linalg.solve(c1, lf[:, :, None])[:, :, 0]
        if sparse is None:
            lm = np.matmul(l1.T, s.m)
            x1 = np.linalg.solve(c1, lm)
            flat = lm.reshape(-1, lm.shape[2])
            rr = s.rr - flat.T @ x1.reshape(-1, lm.shape[2])
            rf = s.rf - flat.T @ y1.ravel()
        else:
            share, n = l1[0, 0] / c1[:, 0, 0], len(s.rr)
            upper = sparse.gram(l1[0, 0] * share, n).reshape(n, n)
            rr = s.rr - upper - np.triu(upper, 1).T
            rf = s.rf - np.bincount(sparse.col, l1[0, 0] * y1[sparse.row, 0] * sparse.value, n)
        yy = s.yy - float(lf.ravel() @ y1.ravel())
        q2, p = s.q2, s.p
        if q2:
            l2, at = np.zeros((q2, q2)), 0
            for t, labels in zip(ls[1:], s.labels[1:], strict=True):
                size = len(labels) * len(t)
                l2[at : at + size, at : at + size] = np.kron(np.eye(len(labels)), t)
                at += size
            if all(len(t) == 1 for t in ls[1:]):
                scale = np.diag(l2)
                c2 = np.eye(q2) + scale[:, None] * rr[:q2, :q2] * scale
            else:
                c2 = np.eye(q2) + l2.T @ rr[:q2, :q2] @ l2
            ch2 = np.linalg.cholesky(c2)
            log_c += 2 * float(np.log(np.diag(ch2)).sum())
            d, f2 = l2.T @ rr[:q2, q2:], l2.T @ rf[:q2]
            both = np.linalg.solve(c2, np.column_stack([d, f2]))
            sx, t = rr[q2:, q2:] - d.T @ both[:, :p], rf[q2:] - d.T @ both[:, p]
            yy -= float(f2 @ both[:, p])
        else:
            sx, t = rr, rf
        log_s = 2 * float(np.log(np.diag(np.linalg.cholesky(sx))).sum()) if p else 0.0
        s_inv = np.linalg.inv(sx)
        beta = np.linalg.solve(sx, t)
    except np.linalg.LinAlgError as e:
        raise NumericalError("the system is not positive definite") from e
    pwrss = yy - float(t @ beta)
    nu = s.n - s.p if reml else s.n
    if not (np.isfinite(pwrss) and pwrss > 0 and nu > 0):
        raise NumericalError("the residual sum of squares is not positive")
    objective = log_c - s.log_w + (log_s if reml else 0.0) + nu * (1 + np.log(2 * np.pi * pwrss / nu))
    u, tail = [], beta
    if q2:
        u2 = both[:, p] - both[:, :p] @ beta
        tail = np.r_[l2 @ u2, beta]
    if sparse is None:
        u1 = y1 - np.einsum("gkc,c->gk", x1, tail)
    else:
        u1 = y1 - (share * np.bincount(sparse.row, sparse.value * tail[sparse.col], len(y1)))[:, None]
    u.append(u1)
    if q2:
        at = 0
        for t_, labels in zip(ls[1:], s.labels[1:], strict=True):
            size = len(labels) * len(t_)
            u.append(u2[at : at + size].reshape(len(labels), -1))
            at += size
    out = beta.copy()
    out[0] += s.shift
    penalty = sum(float((x**2).sum()) for x in u)
    slopes = None
    if gradient:
        blocks = _block_sums(s, c1, None if sparse else x1, share if sparse else None, rr, l2 if q2 else np.zeros((0, 0)), reml)
        full = [2 * np.linalg.solve(t.T, len(x) * np.eye(len(t)) - r - nu / pwrss * (x.T @ x)) for t, x, r in zip(ls, u, blocks, strict=True)]
        slopes = []
        for d, parts in zip(full, s.sizes, strict=True):
            for o, k in zip(np.cumsum(parts) - parts, parts, strict=True):
                slopes += [d[o + j : o + k, o + j] for j in range(k)]
        slopes = np.concatenate(slopes)
    return Point(theta, float(objective), out, u, [x @ t.T for x, t in zip(u, ls, strict=True)], pwrss, float(np.sqrt(pwrss / nu)), log_c, log_s, s_inv, pwrss - penalty, slopes)


def random_system(s: Stats) -> np.ndarray:
    """[Z X r]' W [Z X r], the random columns by term of the formula, then by level, then by column of the level."""
    g, k = s.a.shape[:2]
    q1, q = g * k, g * k + s.q2
    out = np.zeros((q + s.p + 1,) * 2)
    for j in range(k):
        for i in range(k):
            out[np.arange(g) * k + i, np.arange(g) * k + j] = s.a[:, i, j]
    out[:q1, q1:-1] = s.m.reshape(q1, -1)
    out[:q1, -1] = s.f.ravel()
    out[q1:-1, q1:-1], out[q1:-1, -1], out[-1, -1] = s.rr, s.rf, s.yy
    out[q1:, :q1] = out[:q1, q1:].T
    out[-1, q1:-1] = out[q1:-1, -1]
    width = [len(labels) * sum(parts) for labels, parts in zip(s.labels, s.sizes, strict=True)]
    start = np.cumsum(width) - width
    by_formula = [start[place] + np.arange(width[place]) for place in np.argsort(s.order)]
    order = np.r_[np.concatenate(by_formula), np.arange(q, q + s.p + 1)].astype(int)
    return out[np.ix_(order, order)]


def at_factor(s: Stats, factor: np.ndarray, reml: bool) -> Point:
    """The deviance where the covariance of all random effects is sigma^2 factor factor', which may couple levels and terms.

    Rows and columns of factor go by term of the formula, its levels in order, and the columns of a level; u and b of the
    point are lists by term of the formula. One Cholesky factor of the bordered system has both determinants and the residual.
    """
    q, p = s.a.shape[0] * s.a.shape[1] + s.q2, s.p
    if q * q > MOST_FACTOR_CELLS:
        raise ResourceLimitError(f"a factor of {q} random effects is too large to be dense")
    factor = np.asarray(factor, float)
    if factor.shape != (q, q) or not np.isfinite(factor).all():
        raise SpecificationError(f"the factor must be a finite matrix of {q} rows and columns")
    nu = s.n - p if reml else s.n
    whole = random_system(s)
    with np.errstate(over="ignore", invalid="ignore"):
        whole[:, :q] = whole[:, :q] @ factor
        whole[:q] = factor.T @ whole[:q]
    if not np.isfinite(whole).all():
        raise NumericalError("the factor is too large")
    whole[np.arange(q), np.arange(q)] += 1
    try:
        low = np.linalg.cholesky(whole)
    except np.linalg.LinAlgError as e:
        raise NumericalError("the system is not positive definite") from e
    if nu <= 0:
        raise NumericalError("there are no more rows than fixed coefficients")
    log_c, log_s = (2 * float(np.log(np.diag(low)[a:b]).sum()) for a, b in ((0, q), (q, q + p)))
    pwrss = float(low[-1, -1] ** 2)
    solved = np.linalg.solve(low[:-1, :-1].T, low[-1, :-1])
    u, beta = solved[:q], solved[q:].copy()
    beta[0] += s.shift
    root = np.linalg.inv(low[q:-1, q:-1])
    parts, at = [], 0
    for place in np.argsort(s.order):
        shape = len(s.labels[place]), sum(s.sizes[place])
        parts.append((slice(at, at + shape[0] * shape[1]), shape))
        at += shape[0] * shape[1]
    split = lambda v: [v[cut].reshape(shape) for cut, shape in parts]
    objective = log_c - s.log_w + (log_s if reml else 0.0) + nu * (1 + np.log(2 * np.pi * pwrss / nu))
    return Point(np.zeros(0), float(objective), beta, split(u), split(factor @ u), pwrss, float(np.sqrt(pwrss / nu)), log_c, log_s, root.T @ root, pwrss - float(u @ u))


def at_coupled(s: Stats, theta: np.ndarray, left: np.ndarray, right: np.ndarray, reml: bool) -> Point:
    """at_factor for one grouping factor and the factor blocks(theta) + left right', with theta's block for every level.

    left and right have a row for each random effect and few columns, so levels may be coupled, each with each, at the cost
    of a few numbers a level: the system is one by levels and a correction of twice as many columns (Woodbury).
    """
    if s.q2:
        raise SpecificationError("levels of several grouping factors are coupled by a dense factor only")
    (g, k), p = s.a.shape[:2], s.p
    left, right = (np.asarray(x, float) for x in (left, right))
    if left.shape != right.shape or left.ndim != 2 or len(left) != g * k or not (np.isfinite(left).all() and np.isfinite(right).all()):
        raise SpecificationError(f"left and right must be finite matrices of one shape with {g * k} rows")
    (block,) = factors(np.asarray(theta, float), s.sizes)
    r, nu = left.shape[1], s.n - p if reml else s.n
    u3, v3 = (x.reshape(g, k, r) for x in (left, right))
    sums = np.concatenate([s.m, s.f[:, :, None]], axis=2)
    try:
        with np.errstate(over="ignore", invalid="ignore"):
            system, au = np.eye(k) + block.T @ s.a @ block, s.a @ u3
            wide = np.concatenate([block.T @ au, v3], axis=2)  # the system is by levels, plus wide middle wide'
            middle = np.block([[np.zeros((r, r)), np.eye(r)], [np.eye(r), np.einsum("gia,gib->ab", u3, au)]])
            turned = block.T @ sums + v3 @ np.einsum("gia,gib->ab", u3, sums)
            chol = np.linalg.cholesky(system)
            by_level = np.linalg.solve(system, np.concatenate([wide, turned], axis=2))
            inner = np.eye(2 * r) + middle @ np.einsum("gia,gib->ab", wide, by_level[:, :, : 2 * r])
            sign, log_inner = np.linalg.slogdet(inner)
            share = np.linalg.solve(inner, middle @ np.einsum("gia,gib->ab", wide, by_level[:, :, 2 * r :]))
            solved = by_level[:, :, 2 * r :] - by_level[:, :, : 2 * r] @ share
            gram = np.block([[s.rr, s.rf[:, None]], [s.rf[None, :], np.array([[s.yy]])]]) - np.einsum("gia,gib->ab", turned, solved)
        if sign <= 0 or not np.isfinite(gram).all():
            raise NumericalError("the system is not positive definite")
        log_s = 2 * float(np.log(np.diag(np.linalg.cholesky(gram[:p, :p]))).sum()) if p else 0.0
        s_inv, beta = np.linalg.inv(gram[:p, :p]), np.linalg.solve(gram[:p, :p], gram[:p, p])
    except np.linalg.LinAlgError as e:
        raise NumericalError("the system is not positive definite") from e
    log_c = 2 * float(np.log(np.diagonal(chol, axis1=1, axis2=2)).sum()) + float(log_inner)
    pwrss = float(gram[p, p] - gram[:p, p] @ beta)
    if not (np.isfinite(pwrss) and pwrss > 0 and nu > 0):
        raise NumericalError("the residual sum of squares is not positive")
    u = solved @ np.r_[-beta, 1.0]
    b = u @ block.T + u3 @ (right.T @ u.ravel())
    beta[0] += s.shift
    objective = log_c - s.log_w + (log_s if reml else 0.0) + nu * (1 + np.log(2 * np.pi * pwrss / nu))
    return Point(np.zeros(0), float(objective), beta, [u], [b], pwrss, float(np.sqrt(pwrss / nu)), log_c, log_s, s_inv, pwrss - float((u**2).sum()))
