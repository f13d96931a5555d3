"""Minima that are sharp against any fixed step, as those of many rows are."""

import numpy as np
import pytest

from varicomp.lmm import FitControl, diagnose, minimise
from varicomp.operators import pls, stats


def sums(weight, spread):
    """Of y ~ x + (1 + x | g) with 60 groups of 50 rows that weigh this much."""
    rng, x = np.random.default_rng(4), np.arange(50) - 20.0
    y = np.array([rng.normal(0, 0.19) + rng.normal(0, spread * weight**-0.5 / 20) * x + rng.normal(0, weight**-0.5, 50) for _ in range(60)])
    y -= (mean := y.mean())
    cols = np.column_stack([np.ones(50), x])
    a, f = np.broadcast_to(weight * cols.T @ cols, (60, 2, 2)).copy(), weight * (y @ cols)
    return stats.Stats([[f"g{k}" for k in range(60)]], [[2]], a, a.copy(), f, a.sum(axis=0), f.sum(axis=0), float(weight * (y * y).sum()), 3000 * float(np.log(weight)), 3000, 2, float(mean), [0])


@pytest.mark.parametrize("weight, spread", [(1e4, 1), (1e5, 1), (1e7, 1), (1e4, 0)])
def test_a_sharp_minimum_is_one(weight, spread):
    s = sums(weight, spread)
    point, n = minimise(s, False, 3000)
    assert n < 3000 and diagnose(s, point, False, FitControl()) == "ok"
    rng, scale = np.random.default_rng(0), np.maximum(np.abs(point.theta), 1e-6)
    for size in (1e-3, 1e-2, 0.1):
        for _ in range(20):
            near = np.maximum(point.theta + size * scale * rng.normal(size=3), [0, -np.inf, 0])
            assert pls.evaluate(s, near, False).objective > point.objective - 1e-3
    off = point.theta * np.array([1.2, 1.0, 1.0])
    assert diagnose(s, pls.evaluate(s, off, False), False, FitControl()) != "ok"
