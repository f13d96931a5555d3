"""Two random intercepts whose sums stay on executors, by connected components of their levels."""

import numpy as np
import pytest

from varicomp.errors import ResourceLimitError
from varicomp.lmm import lmm, refit
from varicomp.operators import crossed, stats

FORMULA = "y ~ x + (1 | g) + (1 | h)"
SCHEMA = "g string, h string, x double, y double, y2 double, w double"


def rows_of(parts, seed=0):
    """Levels of each (g levels, h levels) of parts occur together only."""
    rng, out = np.random.default_rng(seed), []
    for c, (a, b) in enumerate(parts):
        u, v = rng.normal(0, 1.5, a), rng.normal(0, 0.7, b)
        for _ in range(6 * (a + b)):
            i, j, x, e = rng.integers(a), rng.integers(b), rng.normal(), rng.normal(size=2)
            y = 1 + 0.5 * x + u[i] + v[j] + e[0]
            out.append((f"g{c}-{i}", f"h{c}-{j}", float(x), float(y), float(2 - x + u[i] + e[1]), float(rng.integers(1, 4))))
    return out


@pytest.fixture
def df(spark):
    return spark.createDataFrame(rows_of([(4, 9), (11, 3), (1, 1), (5, 5)]), SCHEMA)


@pytest.mark.parametrize("weights", [None, "w"])
@pytest.mark.parametrize("reml", [False, True])
def test_points_are_those_of_the_driver(df, reml, weights):
    at = lmm(df, FORMULA, reml=reml, weights=weights, theta=np.array([0.8, 0.4]))
    rows = at.frame.rows
    found = crossed.collect(rows, at.kept, [[1], [1]])
    assert found.order == at.stats.order and found.blocks.count() == 4
    for theta in ([0.8, 0.4], [0.0, 0.5], [1.3, 0.0], [0.0, 0.0]):
        theta = np.array(theta)
        want, got = crossed.pls.with_gradient(at.stats, theta, reml), crossed.tier.evaluate_many(found, [theta], reml)[0]
        assert got.objective == pytest.approx(want.objective, abs=1e-8) and got.beta == pytest.approx(want.beta, abs=1e-9)
        assert np.allclose(got.vcov, want.vcov, atol=1e-10) and got.wrss == pytest.approx(want.wrss) and got.gradient == pytest.approx(want.gradient, rel=1e-5, abs=1e-4)


def test_a_fit_over_the_cross_block_of_the_driver(spark, df, monkeypatch):
    want, other = lmm(df, FORMULA), lmm(df, FORMULA.replace("y ", "y2 "))
    monkeypatch.setattr(stats, "MOST_CELLS", 200)
    with pytest.raises(ResourceLimitError):
        lmm(df, FORMULA, sums="driver")
    fit = lmm(df, FORMULA)
    assert isinstance(fit.stats, crossed.Components) and fit.converged
    assert fit.objective == pytest.approx(want.objective, abs=1e-6) and fit.theta == pytest.approx(want.theta, abs=1e-4)
    assert [tuple(r) for r in fit.fixed_effects(spark).collect()] == [(n, pytest.approx(b, rel=1e-5), pytest.approx(s, rel=1e-5)) for n, b, s in want.fixed_effects(spark).collect()]
    assert refit(fit, "y2", df).objective == pytest.approx(other.objective, abs=1e-6)
    with pytest.raises(ResourceLimitError):
        fit.random_effects(spark)


def test_nested_factors(spark, monkeypatch):
    rows = [(f"{g}:{h}", g, *r) for g, h, *r in rows_of([(6, 6)])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = lmm(df, FORMULA)
    monkeypatch.setattr(stats, "MOST_CELLS", 50)
    fit = lmm(df, FORMULA)
    assert fit.stats.blocks.count() == 6 and fit.stats.blocks.agg({"n2": "max"}).first()[0] == 1
    assert fit.objective == pytest.approx(want.objective, abs=1e-6)


def test_roots():
    chain = np.arange(99)
    assert crossed.roots(chain, chain + 1, 100).tolist() == [0] * 100
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 40, (2, 25))
        want = np.arange(40)
        for _ in range(40):
            for i, j in zip(a, b, strict=True):
                want[i] = want[j] = min(want[i], want[j])
        assert crossed.roots(a, b, 40).tolist() == want.tolist()
