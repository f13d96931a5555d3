"""Fits whose sums stay on executors: the same results as on the driver, and none of their levels there."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varicomp.errors import ConvergenceError, ResourceLimitError, SpecificationError
from varicomp.lmm import FitControl, lmm, refit
from varicomp.operators import pls, stats, tier


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(11)
    rows, own = [], rng.normal(size=(60, 2))
    for k in range(900):
        g, x, f = int(rng.integers(60)), float(rng.normal()), "abc"[int(rng.integers(3))]
        y = 2 + x + 0.5 * (f == "b") + own[g, 0] + 0.6 * own[g, 1] * x + rng.normal()
        rows.append((f"g{g}", f"h{k % 7}", f, x, float(y), float(-y + x * x), float(1 + k % 3), 0.1 * (k % 4)))
    return spark.createDataFrame(rows, "g string, h string, f string, x double, y double, y2 double, w double, o double").repartition(5).persist()


@pytest.mark.parametrize("reml", [True, False])
@pytest.mark.parametrize("formula", ["y ~ x + (1 | g)", "y ~ x * f + (1 + x | g)", "y ~ x + f + (1 + x || g)", "y ~ f + (1 + f | g)"])
def test_executors_find_what_the_driver_does(spark, df, formula, reml):
    options = {"weights": "w", "offset": "o", "reml": reml}
    want, got = (lmm(df, formula, sums=s, **options) for s in ("driver", "executors"))
    assert got.objective == pytest.approx(want.objective, abs=1e-6) and np.allclose(got.theta, want.theta, atol=2e-4)
    at = want.theta
    want, got = (lmm(df, formula, sums=s, theta=at, **options) for s in ("driver", "executors"))
    assert got.objective == pytest.approx(want.objective, abs=1e-8) and got.sigma == pytest.approx(want.sigma, abs=1e-10)
    assert np.allclose(got.beta, want.beta, atol=1e-9) and np.allclose(got.vcov, want.vcov, atol=1e-10)
    assert got.point.wrss == pytest.approx(want.point.wrss, rel=1e-9)
    effects = [sorted(map(tuple, fit.random_effects(spark).collect())) for fit in (want, got)]
    assert [r[:3] for r in effects[0]] == [r[:3] for r in effects[1]] and np.allclose([r[3:] for r in effects[0]], [r[3:] for r in effects[1]], atol=1e-9)
    new = df.limit(40).withColumn("g", F.when(F.col("x") > 0, F.lit("new")).otherwise(F.col("g")))
    values = [sorted(map(tuple, fit.predict(new, allow_new_groups=True, offset="o").select("y", "prediction", "new_group").collect())) for fit in (want, got)]
    assert np.allclose(values[0], values[1], atol=1e-9)


def test_gradients_and_batches(df):
    found = lmm(df, "y ~ x + (1 + x | g)", sums="executors", theta=np.array([1.0, 0.1, 0.5])).stats
    here = np.array([0.8, -0.2, 0.4])
    step = [here + e * s for e in np.eye(3) * 1e-4 for s in (1, -1)]
    point, *near = tier.evaluate_many(found, [here, *step], True)
    assert np.allclose(point.gradient, [(near[2 * k].objective - near[2 * k + 1].objective) / 2e-4 for k in range(3)], rtol=1e-5, atol=1e-4)
    edge = tier.evaluate_many(found, [np.array([0.8, 0.0, 0.0])], False)[0]
    assert np.isfinite(edge.gradient).all()


def test_too_many_levels_for_the_driver(spark, df, monkeypatch):
    monkeypatch.setattr(stats, "MOST_CELLS", 5)
    fit = lmm(df, "y ~ x + (1 | g)")
    assert isinstance(fit.stats, tier.LevelTable) and fit.converged and fit.stats.levels == 60
    assert fit.random_effects(spark).count() == 60 and fit.fixed_effects(spark).count() == 2
    with pytest.raises(ResourceLimitError, match="executors"):
        fit.stats.labels
    for bad in ({"sums": "driver"}, {"formula": "y ~ x + (1 | g) + (1 | h)"}):
        with pytest.raises(ResourceLimitError):
            lmm(df, **{"formula": "y ~ x + (1 | g)", **bad})
    other = refit(fit, "y2", df)
    monkeypatch.undo()
    assert other.objective == pytest.approx(lmm(df, "y2 ~ x + (1 | g)").objective, abs=1e-6)


def test_no_level_reaches_the_driver(df, monkeypatch):
    """All that is fetched are sums over levels: a bounded number of cells for a theta."""
    fetched = []
    frame = type(df)
    real = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: fetched.append(len(out := real(self))) or out)
    monkeypatch.setattr(frame, "toPandas", lambda self: pytest.fail("a table went to the driver"))
    fit = lmm(df, "y ~ x + (1 | g)", sums="executors", levels={"f": ["a", "b", "c"]})
    assert fit.converged and max(fetched) <= 3 * (1 + 1 + 9 + 9) * 8


def test_no_variance_between_groups(spark):
    """The minimum at the bound is exactly 0."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    rows = [(f"g{k % 15}", float(x[k]), float(1 + x[k] + e)) for k, e in enumerate(np.tile(rng.normal(size=20), (15, 1)).T.ravel())]
    fit = lmm(spark.createDataFrame(rows, "g string, x double, y double"), "y ~ x + (1 | g)", sums="executors")
    assert fit.theta[0] == 0 and fit.boundary and pls.n_theta(fit.stats.sizes) == 1


def test_limits_and_options(df):
    with pytest.raises(ConvergenceError, match="evaluations"):
        lmm(df, "y ~ x + (1 + x | g)", sums="executors", control=FitControl(most_evaluations=2))
    with pytest.raises(SpecificationError):
        lmm(df, "y ~ x + (1 | g)", sums="elsewhere")
    with pytest.raises(SpecificationError):
        lmm(df, "y ~ x + (1 | g) + (1 | h)", sums="executors")
    with pytest.raises(SpecificationError):
        lmm(df, "y ~ x + (1 | g)", sums="executors", theta=np.array([1.0, 2.0]))
