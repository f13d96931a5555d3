"""The deviance at a factor of all random effects, which may couple levels and terms."""

import duckdb
import numpy as np
import pytest
from test_library import SCHEMA, table

from varicomp import queries
from varicomp.errors import NumericalError, ResourceLimitError, SpecificationError
from varicomp.lmm import lmm
from varicomp.operators import pls

FORMULA = "y ~ x + (1 | h) + (1 + x | g)"


@pytest.fixture(scope="module")
def sums(spark):
    return lmm(spark.createDataFrame(table(), SCHEMA), FORMULA, weights="w", theta=np.array([0.4, 0.9, 0.3, 0.5])).stats


def by_rows(factor, reml):
    """Generalised least squares from the rows' own covariance."""
    rows = table()
    n, h, g = len(rows), sorted({r[2] for r in rows}), sorted({r[1] for r in rows})
    z = np.zeros((n, len(h) + 2 * len(g)))
    for i, r in enumerate(rows):
        z[i, h.index(r[2])] = 1
        z[i, len(h) + 2 * g.index(r[1]) : len(h) + 2 * g.index(r[1]) + 2] = 1, r[4]
    x, y, w = np.array([[1, r[4]] for r in rows]), np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    v = np.diag(1 / w) + z @ factor @ factor.T @ z.T
    vi = np.linalg.inv(v)
    s = x.T @ vi @ x
    beta = np.linalg.solve(s, x.T @ vi @ y)
    e = y - x @ beta
    rss, nu = float(e @ vi @ e), n - 2 * reml
    b = factor @ factor.T @ z.T @ vi @ e
    return np.linalg.slogdet(v)[1] + reml * np.linalg.slogdet(s)[1] + nu * (1 + np.log(2 * np.pi * rss / nu)), beta, rss / nu * np.linalg.inv(s), b


@pytest.mark.parametrize("reml", [False, True])
def test_factors_that_couple_everything(sums, reml):
    for seed in range(3):
        factor = np.random.default_rng(seed).normal(0, 0.6, (16, 16))
        factor[:, seed] = 0  # singular ones too
        got, (objective, beta, vcov, b) = pls.at_factor(sums, factor, reml), by_rows(factor, reml)
        assert got.objective == pytest.approx(objective, abs=1e-9) and got.beta == pytest.approx(beta, abs=1e-9)
        assert np.allclose(got.vcov, vcov, atol=1e-9) and np.concatenate([x.ravel() for x in got.b]) == pytest.approx(b, abs=1e-9)
        assert [x.shape for x in got.b] == [(4, 1), (6, 2)]


@pytest.mark.parametrize("reml", [False, True])
def test_a_factor_by_levels_is_theta(sums, reml):
    factor = np.zeros((16, 16))
    factor[:4, :4] = 0.4 * np.eye(4)
    factor[4:, 4:] = np.kron(np.eye(6), [[0.9, 0], [0.3, 0.5]])
    # theta follows the order of the sums, with the factor of most columns first
    terms = {0: [0.4], 1: [0.9, 0.3, 0.5]}
    want, got = pls.evaluate(sums, np.concatenate([terms[t] for t in sums.order]), reml), pls.at_factor(sums, factor, reml)
    assert got.objective == pytest.approx(want.objective, abs=1e-9) and got.beta == pytest.approx(want.beta, abs=1e-9)
    assert got.wrss == pytest.approx(want.wrss) and got.log_c == pytest.approx(want.log_c) and got.log_s == pytest.approx(want.log_s)
    for place, t in enumerate(sums.order):
        assert np.allclose(got.u[t], want.u[place], atol=1e-9)


def test_factors_that_are_refused(sums, monkeypatch):
    for factor in (np.eye(15), np.full((16, 16), np.nan), np.zeros(16)):
        with pytest.raises(SpecificationError):
            pls.at_factor(sums, factor, True)
    with pytest.raises(NumericalError):
        pls.at_factor(sums, np.full((16, 16), 1e200), True)
    monkeypatch.setattr(pls, "MOST_FACTOR_CELLS", 200)
    with pytest.raises(ResourceLimitError):
        pls.at_factor(sums, np.eye(16), True)


@pytest.mark.parametrize("formula, theta", [("y ~ x + (1 | g)", [0.8]), ("y ~ x + (1 + x | g)", [0.9, 0.3, 0.5]), ("y ~ x + (1 + x || g)", [0.7, 0.0])])
@pytest.mark.parametrize("reml", [False, True])
def test_a_few_columns_that_couple_levels(spark, formula, theta, reml):
    s = lmm(spark.createDataFrame(table(), SCHEMA), formula, weights="w", theta=np.array(theta)).stats
    (block,) = pls.factors(np.array(theta), s.sizes)
    q = len(s.labels[0]) * len(block)
    for r in (1, 3):
        left, right = np.random.default_rng(r).normal(0, 0.6, (2, q, r))
        got = pls.at_coupled(s, np.array(theta), left, right, reml)
        want = pls.at_factor(s, np.kron(np.eye(len(s.labels[0])), block) + left @ right.T, reml)
        assert got.objective == pytest.approx(want.objective, abs=1e-8) and got.beta == pytest.approx(want.beta, abs=1e-8)
        assert np.allclose(got.vcov, want.vcov, atol=1e-9) and got.wrss == pytest.approx(want.wrss)
        assert np.allclose(got.u[0], want.u[0], atol=1e-8) and np.allclose(got.b[0], want.b[0], atol=1e-8)


def test_columns_that_are_refused(sums, spark):
    with pytest.raises(SpecificationError):
        pls.at_coupled(sums, np.array([0.4, 0.9, 0.3, 0.5]), np.ones((16, 1)), np.ones((16, 1)), True)
    one = lmm(spark.createDataFrame(table(), SCHEMA), "y ~ x + (1 | g)", theta=np.array([0.8])).stats
    for left, right in ((np.ones((5, 1)), np.ones((5, 1))), (np.ones((6, 1)), np.ones((6, 2))), (np.full((6, 1), np.nan), np.ones((6, 1)))):
        with pytest.raises(SpecificationError):
            pls.at_coupled(one, np.array([0.8]), left, right, True)
    with pytest.raises(NumericalError):
        pls.at_coupled(one, np.array([0.8]), np.full((6, 1), 1e200), np.ones((6, 1)), True)


def test_the_query_couples_more_levels_than_a_dense_factor_holds(spark, monkeypatch):
    want = queries.coupled_deviance(spark, "/root/testdata/sf0.001").first()
    monkeypatch.setattr(pls, "MOST_FACTOR_CELLS", 10)
    assert queries.coupled_deviance(spark, "/root/testdata/sf0.001").first() == want


def test_the_query_is_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
    want = con.execute(queries.ORACLE["coupled_deviance"]).df()
    got = queries.coupled_deviance(spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and np.allclose(got[sorted(got)], want[sorted(want)])
