import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varicomp.errors import ArtifactError, FormulaError, PredictionError, SpecificationError
from varicomp.functions import distributions as dist
from varicomp.lmm import lmm, refit
from varicomp.operators import frame, grid, infer, linear, pls, profile, simulate, stats
from varicomp.plans import formula
from varicomp.sources import artifact
from varicomp.streaming import incremental


def table(n=60, groups=6, seed=0):
    rng = np.random.default_rng(seed)
    b, s = rng.normal(0, 1.5, groups), rng.normal(0, 0.5, groups)
    out = []
    for k in range(n):
        g, x, f = k % groups, float(rng.normal()), "abc"[(k // groups) % 3]
        y = float(1 + b[g] + (0.5 + s[g]) * x + (f == "b") * 0.7 + rng.normal())
        out.append((f"r{k}", f"g{g}", f"h{(k * 7 + k // 5) % 4}", f, x, y, 0.5 + (k % 3)))
    return out


SCHEMA = "row_id string, g string, h string, f string, x double, y double, w double"


def dense(rows, theta, reml, slope=False, crossed=False, fixed=lambda r: [1, r[4]]):
    """The deviance from the marginal covariance, with no group algebra."""
    y, x, w = np.array([r[5] for r in rows]), np.array([fixed(r) for r in rows], float), np.array([r[6] for r in rows])
    v = np.diag(1 / w)
    for t, at, cols in ((theta[0], 1, slope),) + (((theta[1], 2, False),) if crossed else ()):
        lab = sorted({r[at] for r in rows})
        z = np.zeros((len(rows), len(lab) * (2 if cols else 1)))
        for i, r in enumerate(rows):
            j = lab.index(r[at])
            if cols:
                z[i, 2 * j], z[i, 2 * j + 1] = 1, r[4]
            else:
                z[i, j] = 1
        v += z @ np.kron(np.eye(len(lab)), t @ t.T if cols else np.array([[t * t]])) @ z.T
    vi = np.linalg.inv(v)
    s = x.T @ vi @ x
    beta = np.linalg.solve(s, x.T @ vi @ y)
    e = y - x @ beta
    rss, n = float(e @ vi @ e), len(y)
    nu = n - x.shape[1] if reml else n
    return np.linalg.slogdet(v)[1] + (np.linalg.slogdet(s)[1] if reml else 0) + nu * (1 + np.log(2 * np.pi * rss / nu)), beta


@pytest.mark.parametrize("reml", [False, True])
def test_fixed_theta_matches_dense_algebra(spark, reml):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    got = lmm(df, "y ~ x + (1 | g)", reml=reml, weights="w", theta=np.array([0.9])).point
    want, beta = dense(rows, [0.9], reml)
    assert got.objective == pytest.approx(want, abs=1e-9) and got.beta == pytest.approx(beta, abs=1e-10)
    t = np.array([[0.9, 0], [-0.3, 0.4]])
    got = lmm(df, "y ~ x + (1 + x | g)", reml=reml, weights="w", theta=np.array([0.9, -0.3, 0.4])).point
    assert got.objective == pytest.approx(dense(rows, [t], reml, slope=True)[0], abs=1e-9)
    crossed = lmm(df, "y ~ x + (1 | g) + (1 | h)", reml=reml, weights="w", theta=np.array([0.9, 0.6])).point
    assert crossed.objective == pytest.approx(dense(rows, [0.9, 0.6], reml, crossed=True)[0], abs=1e-9)


def test_optimum_recorded_for_the_large_generator(spark):
    b = spark.range(100_000).selectExpr("id", "id div 100 gi", "concat('group-', lpad(cast(id div 100 as string), 5, '0')) grp", "0.75 + (id % 11) / 10 w", "0.05 * cos(id * 0.031) off")
    b = b.selectExpr("*", "2.5 + 0.8 * sin(gi * 0.013) + 0.2 * sin(id * 0.17) + 0.1 * cos(id * 0.071) + off y")
    fit = lmm(b, "y ~ 1 + (1 | grp)", reml=False, weights="w", offset="off")
    assert fit.objective == pytest.approx(-74522.12829728935, abs=1e-5)
    assert fit.theta[0] == pytest.approx(3.1514397929266083, abs=2e-4) and fit.sigma == pytest.approx(0.1768229564767533, abs=1e-5)


def test_balanced_one_way_has_closed_forms(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(0, 2, 6)[:, None] + rng.normal(0, 1, (6, 5))
    df = spark.createDataFrame([(f"g{i}", float(v)) for i, r in enumerate(y) for v in r], "g string, y double")
    fit = lmm(df, "y ~ 1 + (1 | g)")
    within = float(((y - y.mean(axis=1, keepdims=True)) ** 2).sum() / 24)
    between = 5 * float(((y.mean(axis=1) - y.mean()) ** 2).sum() / 5)
    assert fit.sigma**2 == pytest.approx(within, rel=1e-6)
    assert fit.covariances[0][0, 0] == pytest.approx((between - within) / 5, rel=1e-5)
    s = infer.satterthwaite(fit).test([1])
    assert s.df2 == pytest.approx(5, abs=1e-3)
    assert infer.kenward_roger(fit).test([1]).df2 == pytest.approx(5, abs=1e-6)
    lo, hi = infer.profile_interval(fit, ".sigma")
    assert lo < fit.sigma < hi


def test_boundary_fit_is_least_squares(spark):
    df = spark.createDataFrame([(f"g{k % 3}", float(k % 5), float((k * 7) % 5)) for k in range(45)], "g string, y double, x double")
    fit = lmm(df, "y ~ x + (1 | g)", reml=False)
    assert fit.boundary and fit.theta[0] == 0
    assert fit.beta == pytest.approx(linear.ols(df, "y", ["x"]).beta, abs=1e-9)
    assert infer.satterthwaite(fit).status == "boundary" and infer.kenward_roger(fit).status == "boundary"


def test_rows_nulls_and_errors(spark):
    rows = table() + [("n1", "g0", "h0", "a", None, 1.0, 1.0), ("n2", "g0", "h0", "a", float("nan"), 1.0, 1.0), ("n3", None, "h0", "a", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).withColumn("keep", F.col("row_id") != "r0")
    with pytest.raises(SpecificationError):
        lmm(df, "y ~ x + (1 | g)")
    fit = lmm(df, "y ~ x + (1 | g)", na_action="omit", subset="keep")
    assert fit.stats.n == 59
    counts = {r[0]: r[1] for r in fit.frame.status.groupBy("__status").count().collect()}
    assert counts == {"retained": 59, "omitted": 3, "excluded": 1}
    for bad in ("y ~ x", "y ~ log(x) + (1 | g)", "y ~ 1 + (1 + x | g)", "y ~ x + (1 | g) + (1 | g)"):
        with pytest.raises(FormulaError):
            formula.parse(bad)
    with pytest.raises(SpecificationError):
        lmm(df.withColumn("k", F.lit(1)), "y ~ x + (1 | k)", na_action="omit")
    with pytest.raises(SpecificationError):
        lmm(df.where("false"), "y ~ x + (1 | g)")


def test_formula_forms():
    f = formula.parse("y ~ a * b + offset(o) + (1 | s/c)")
    assert f.fixed == (("a",), ("b",), ("a", "b")) and f.offsets == ("o",) and [t.name for t in f.random] == ["c:s", "s"]
    assert formula.parse("y ~ x + (1 | g) + (0 + x | g)") == formula.parse("y ~ x + (1 + x || g)")


def test_rank_and_estimability(spark):
    df = spark.createDataFrame(table(), SCHEMA).withColumn("x2", 2 * F.col("x"))
    fit = lmm(df, "y ~ x + x2 + f + (1 | g)")
    assert [fit.names[k] for k in fit.kept] == ["(Intercept)", "x", "fb", "fc"] and math.isnan(fit.full_beta[2])
    assert fit.is_estimable([0, 1, 2, 0, 0]) and not fit.is_estimable([0, 1, 0, 0, 0])
    assert infer.contrast(fit, [0, 1, 0, 0, 0]).status == "not_estimable"
    out = fit.predict(df.withColumn("x2", F.when(F.col("row_id") == "r1", F.col("x")).otherwise(F.col("x2")))).where("not estimable").collect()
    assert [r.row_id for r in out] == ["r1"] and math.isnan(out[0].prediction)


def test_prediction_of_new_groups_and_levels(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    fit = lmm(df, "y ~ x + f + (1 | g)")
    new = df.withColumn("g", F.when(F.col("row_id") == "r1", "new").otherwise(F.col("g")))
    with pytest.raises(Exception, match="a group was not in the fit"):
        fit.predict(new).collect()
    flagged = {r.row_id: (r.prediction, r.new_group) for r in fit.predict(new, allow_new_groups=True).collect()}
    population = {r.row_id: r.prediction for r in fit.predict(df, "population").collect()}
    assert flagged["r1"] == (pytest.approx(population["r1"]), True) and sum(v[1] for v in flagged.values()) == 1
    with pytest.raises(Exception, match="a fixed level was not in the fit"):
        fit.predict(df.withColumn("f", F.lit("zzz"))).collect()
    with pytest.raises(PredictionError):
        fit.predict(df, "other")


def test_refit_and_artifact(spark, tmp_path):
    df = spark.createDataFrame(table(), SCHEMA).withColumn("y2", 3 * F.col("y") - 1)
    fit = lmm(df, "y ~ x + f + (1 | g)")
    again = refit(fit, "y2", df)
    assert again.beta[1:] == pytest.approx(3 * fit.beta[1:], rel=1e-5) and again.theta == pytest.approx(fit.theta, rel=1e-4)
    path = f"file://{tmp_path}/m"
    artifact.save(fit, spark, path)
    back = artifact.load(spark, path)
    a, b = ({r.row_id: r.prediction for r in m.predict(df).collect()} for m in (fit, back))
    assert a == pytest.approx(b)
    spark.createDataFrame([("{}", "0")], "body string, sha256 string").write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(ArtifactError):
        artifact.load(spark, f"file://{tmp_path}/bad")


def test_cluster_robust_against_dense(spark):
    rows = table()
    fit = lmm(spark.createDataFrame(rows, SCHEMA), "y ~ x + (1 | g)", theta=np.array([0.8]))
    x, y, g = np.array([[1, r[4]] for r in rows]), np.array([r[5] for r in rows]), np.array([r[1] for r in rows])
    t = np.eye(60) + 0.64 * (g[:, None] == g[None, :])
    w = np.linalg.inv(t)
    b = np.linalg.inv(x.T @ w @ x)
    e = y - x @ fit.beta
    meat, meat2 = np.zeros((2, 2)), np.zeros((2, 2))
    for k in sorted(set(g)):
        m = g == k
        s = x[m].T @ w[np.ix_(m, m)] @ e[m]
        meat += np.outer(s, s)
        r = np.linalg.cholesky(t[np.ix_(m, m)]).T
        d, q = np.linalg.eigh(r @ (t[np.ix_(m, m)] - x[m] @ b @ x[m].T) @ r.T)
        s = x[m].T @ w[np.ix_(m, m)] @ r.T @ q @ np.diag(d**-0.5) @ q.T @ r @ e[m]
        meat2 += np.outer(s, s)
    assert infer.cluster_robust(fit, kind="CR0").vcov == pytest.approx(b @ meat @ b, rel=1e-8)
    assert infer.cluster_robust(fit, kind="CR1").vcov == pytest.approx(b @ meat @ b * 6 / 5, rel=1e-8)
    cr2 = infer.cluster_robust(fit, kind="CR2")
    assert cr2.vcov == pytest.approx(b @ meat2 @ b, rel=1e-6) and 0 < cr2.test([0, 1]).df2 < 6


def test_profile_of_a_coefficient(spark):
    fit = lmm(spark.createDataFrame(table(), SCHEMA), "y ~ x + (1 | g)", reml=False)
    lo, hi = infer.profile_interval(fit, "x")
    se = math.sqrt(fit.vcov[1, 1])
    assert lo < fit.beta[1] < hi and (hi - lo) / (2 * 1.96 * se) == pytest.approx(1, abs=0.1)


def test_means_pairs_and_adjustment(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    fit = lmm(df, "y ~ x + f + (1 | g)")
    means = grid.marginal_means(fit, df, ["f"])
    by = {r.f: r.estimate for r in means.collect()}
    pairs = {(r.level_1, r.level_2): (r.estimate, r.std_error) for r in grid.pairwise(means, fit, "f").collect()}
    assert len(pairs) == 3 and pairs["a", "b"][0] == pytest.approx(by["a"] - by["b"]) == pytest.approx(-fit.beta[2])
    assert pairs["a", "b"][1] == pytest.approx(math.sqrt(fit.vcov[2, 2]))
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p_value double")
    holm = {r.k: r.p_adjusted for r in grid.adjust(tests).collect()}
    assert holm == {"a": pytest.approx(0.04), "c": pytest.approx(0.09), "b": pytest.approx(0.09), "d": None}


def test_bootstrap_is_invariant_and_resumes(spark):
    fit = lmm(spark.createDataFrame(table(), SCHEMA), "y ~ x + (1 | g)")
    rows = fit.frame.rows.withColumn("__id", F.xxhash64("__y", "__x1"))
    key = lambda d: sorted((r.replicate, r.status, round(r.sigma, 6)) for r in d.collect())
    one = simulate.bootstrap(fit, rows, 12, 5, "__id")
    assert key(one) == key(simulate.bootstrap(fit, rows.repartition(7), 12, 5, "__id"))
    rest = simulate.bootstrap(fit, rows, 12, 5, "__id", done=one.where("replicate < 7"))
    assert sorted(r.replicate for r in rest.collect()) == [7, 8, 9, 10, 11]
    n, bad, bound = simulate.failure_bound(one)
    assert (n, bad) == (12, 0) and bound == pytest.approx(1 - 0.05 ** (1 / 12))
    z = spark.range(20_000).select(simulate.normal(3, "t", F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 1) < 0.03


def test_interval_matches_linear_quantiles(spark):
    v = np.random.default_rng(1).normal(size=101)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    r = simulate.interval(df, "v", 0.9).first()
    assert (r.lower, r.upper) == (pytest.approx(np.quantile(v, 0.05)), pytest.approx(np.quantile(v, 0.95)))


def test_stream_sums(spark, tmp_path):
    rows = spark.createDataFrame(table(), SCHEMA)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    q = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(incremental.appender(f"{tmp_path}/sums", "g", "y", "x")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.level: (r.n, pytest.approx(r.sxy)) for r in incremental.merged(spark.read.parquet(f"{tmp_path}/sums")).collect()}
    assert got == {r.level: (r.n, r.sxy) for r in incremental.batch_sums(rows, "g", "y", "x").collect()}


def test_distributions():
    assert dist.norm_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-10)
    assert dist.t_sf(2.570581835636314, 5) == pytest.approx(0.025, rel=1e-9)
    assert dist.f_sf(4.256494729093749, 2, 9) == pytest.approx(0.05, rel=1e-8)
    assert dist.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-10)
    assert dist.t_ppf(0.975, 5) == pytest.approx(2.570581835636314, rel=1e-8)
    assert dist.beta_ppf(0.95, 1, 9) == pytest.approx(1 - 0.05 ** (1 / 9), rel=1e-8)


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 6), st.integers(0, 10**6))
def test_dependent_columns_are_found(p, seed):
    x = np.random.default_rng(seed).normal(size=(30, p))
    x = np.column_stack([x, x[:, 0] + 2 * x[:, -1]])
    assert stats.independent_columns(np.linalg.qr(x, mode="r")) == list(range(p))


def test_theta_layout():
    (t,) = pls.factors(np.array([1.0, 2, 3]), [[2]])
    assert t.tolist() == [[1, 0], [2, 3]] and pls.n_theta([[1, 1], [2]]) == 5
    assert frame.Encoder((("f",),), {"f": ["a", "b", "c"]}, {"f": "sum"}).variable("f")[1][0] == "f2"


def test_joint_robust_test(spark):
    fit = lmm(spark.createDataFrame(table(), SCHEMA), "y ~ x + f + (1 | g)", theta=np.array([0.8]))
    cr2 = infer.cluster_robust(fit, kind="CR2")
    one, joint = cr2.test([0, 1, 0, 0]), cr2.test([[0, 1, 0, 0], [0, 0, 1, 0]])
    b, l = fit.point.s_inv, np.array([0, 1, 0, 0])
    h = np.einsum("i,ij,cjk,kl->cl", l, b, cr2.ex, np.linalg.cholesky(b))
    p = -h @ h.T + np.diag(np.einsum("i,ij,cjk,kl,l->c", l, b, cr2.ete, b, l))
    assert one.df2 == pytest.approx(np.trace(p) ** 2 / (p**2).sum())
    # the same hypothesis in other coordinates gives the same test
    mixed = cr2.test([[0, 1, 1, 0], [0, 2, -3, 0]])
    assert joint.status == "ok" and (mixed.statistic, mixed.df2, mixed.p_value) == pytest.approx((joint.statistic, joint.df2, joint.p_value))
    wald = infer.cluster_robust(fit, kind="CR1").test([[0, 1, 0, 0], [0, 0, 1, 0]])
    assert wald.df2 == np.inf and wald.p_value == pytest.approx(dist.chi2_sf(wald.statistic, 2))
    with pytest.raises(SpecificationError):
        cr2.test([[0, 1, 0, 0], [0, 2, 0, 0]])


def test_profile_of_all_parameters(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    fit = lmm(df, "y ~ x + (1 | g)", reml=False)
    found = {t.target: t for t in profile.likelihood_profile(fit)}
    assert list(found) == [".sig01", ".sigma", "(Intercept)", "x"]
    for target in found:
        if target != "(Intercept)":
            assert found[target].interval()[:2] == pytest.approx(infer.profile_interval(fit, target), rel=5e-3)
        assert (np.diff(found[target].values) > 0).all() and (np.diff(found[target].roots) > 0).all()
    plain = {r.target: r for r in profile.intervals(spark, list(found.values())).collect()}
    squared = {r.target: r for r in profile.intervals(spark, list(found.values()), scale="varcov").collect()}
    assert squared[".sig01"].upper == pytest.approx(plain[".sig01"].upper ** 2) and squared["x"].upper == plain["x"].upper
    slope = {t.target: t for t in profile.likelihood_profile(lmm(df, "y ~ x + (1 + x | g)", reml=False), [".sig01", ".sig02", ".sig03", ".sigma"])}
    assert {t.status for t in slope.values()} == {"ok"} and -1 < slope[".sig03"].estimate < 1
    for t in slope.values():
        lo, hi, status = t.interval()
        assert status in ("ok", "boundary") and lo < t.estimate < hi
    with pytest.raises(SpecificationError):
        profile.likelihood_profile(fit, ["z"])


def test_monotone_cubic_keeps_the_points():
    x, y = np.array([0.0, 1, 2, 4]), np.array([0.0, 1, 8, 9])
    assert [profile.monotone_cubic(x, y, v) for v in x] == pytest.approx(y.tolist())
    assert np.all(np.diff([profile.monotone_cubic(x, y, v) for v in np.linspace(0, 4, 200)]) >= 0)
