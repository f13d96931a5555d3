"""Exact gradients of the profiled deviance, and the quasi-Newton search that uses them."""

import numpy as np
import pytest

from varicomp.lmm import minimise
from varicomp.operators import pls
from varicomp.operators.stats import Stats
from varicomp.plans import optimize


def sums(rng, levels, sizes, p=2, n=600, noise=1.0, spread=1.0):
    """The sums that a fit makes from rows, of random rows."""
    order = sorted(range(len(levels)), key=lambda t: -levels[t])
    levels, sizes = [levels[t] for t in order], [sizes[t] for t in order]
    x = np.column_stack([np.ones(n), rng.normal(size=(n, p - 1))])
    w = rng.uniform(0.5, 2, n)
    z, y = [], x @ rng.normal(size=p) + noise * rng.normal(size=n)
    for count, parts in zip(levels, sizes, strict=True):
        k, at = sum(parts), rng.integers(0, count, n)
        at[:count] = np.arange(count)
        cover = np.column_stack([np.ones(n), rng.normal(size=(n, k - 1))]) if k > 1 else np.ones((n, 1))
        dense = np.zeros((n, count, k))
        dense[np.arange(n), at] = cover
        z.append(dense.reshape(n, -1))
        y = y + z[-1] @ (spread * rng.normal(size=count * k))
    k1 = sum(sizes[0])
    tail = np.column_stack([*z[1:], x])
    zw = z[0] * w[:, None]
    g = levels[0]
    pick = lambda a: np.stack([a[c * k1 : (c + 1) * k1] for c in range(g)])
    a = np.stack([(zw.T @ z[0])[c * k1 : (c + 1) * k1, c * k1 : (c + 1) * k1] for c in range(g)])
    names = [[str(i) for i in range(c)] for c in levels]
    return Stats(names, sizes, a, pick(zw.T @ tail), pick(zw.T @ y), (tail * w[:, None]).T @ tail, (tail * w[:, None]).T @ y, float(w @ y**2), float(np.log(w).sum()), n, p, 0.0, list(range(len(levels))))


CASES = [([30], [[1]]), ([30], [[2]]), ([25], [[1, 1]]), ([40, 12], [[1], [1]]), ([20, 8], [[2], [1]]), ([20, 8, 5], [[2], [2], [1]]), ([300, 20, 6], [[1], [1], [1]])]


@pytest.mark.parametrize("reml", [True, False])
@pytest.mark.parametrize(("levels", "sizes"), CASES)
def test_gradient_is_the_objectives(levels, sizes, reml):
    rng = np.random.default_rng(len(levels))
    s = sums(rng, levels, sizes)
    theta = rng.uniform(0.3, 1.5, pls.n_theta(s.sizes))
    got = pls.with_gradient(s, theta, reml).gradient
    for k in range(len(theta)):
        e = np.eye(len(theta))[k] * 1e-5
        want = (pls.evaluate(s, theta + e, reml).objective - pls.evaluate(s, theta - e, reml).objective) / 2e-5
        assert got[k] == pytest.approx(want, rel=1e-5, abs=1e-4)


def test_gradient_of_sparse_sums():
    s = sums(np.random.default_rng(7), [300, 20, 6], [[1], [1], [1]])
    assert s.sparse is not None


@pytest.mark.parametrize("spread", [1.0, 0.1, 0.0])
@pytest.mark.parametrize(("levels", "sizes"), CASES)
def test_few_evaluations_reach_the_minimum(levels, sizes, spread):
    for seed in range(3):
        s = sums(np.random.default_rng(seed), levels, sizes, spread=spread)
        low = pls.lower_bounds(s.sizes)
        point, n = minimise(s, True)
        slow = optimize.vector(lambda t: pls.evaluate(s, t, True).objective, (low == 0).astype(float), low)
        assert point.objective <= pls.evaluate(s, slow, True).objective + 1e-6
        if spread == 1.0:
            assert n <= 40 and np.allclose(point.theta, slow, atol=2e-4)


def test_bounds_hold():
    target = np.array([-1.0, 2.0, 0.5])
    bend = np.array([[3, 1, 0.5], [1, 2, 0.2], [0.5, 0.2, 1]])
    fg = lambda x: (float((x - target) @ bend @ (x - target)), 2 * bend @ (x - target))
    x, settled = optimize.quasi_newton(fg, np.ones(3), np.array([0.0, -np.inf, 0.0]))
    rest = np.linalg.solve(bend[1:, 1:], bend[1:, 1:] @ target[1:] + bend[1:, 0] * target[0])
    assert settled and 0 <= x[0] < 1e-8 and np.allclose(x[1:], rest, atol=1e-4)
