"""Faults that were found in reviews, each with the case that showed it; and the layers built on a fit."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_library import SCHEMA, table

from varicomp.errors import ArtifactError, ConvergenceError, IncompleteError, LedgerError, ResourceLimitError, SpecificationError
from varicomp.functions import distributions as dist
from varicomp.lmm import FitControl, lmm, refit
from varicomp.operators import frame, grid, infer, pls, simulate, stats
from varicomp.operators.postfit import PostFit
from varicomp.sources import artifact, files, ledger


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(table(), SCHEMA).persist()


@pytest.fixture(scope="module")
def fit(df):
    return lmm(df, "y ~ x + f + (1 | g)")


def test_a_null_subset_is_refused(df):
    marked = df.withColumn("keep", F.when(F.col("x") > -0.5, F.col("x") < 1))
    with pytest.raises(SpecificationError, match="null in"):
        lmm(marked, "y ~ x + (1 | g)", subset="keep")


def test_missing_values_are_named(df):
    with pytest.raises(SpecificationError, match="x in"):
        lmm(df.withColumn("x", F.when(F.col("x") > 0, F.col("x"))), "y ~ x + (1 | g)")


def test_a_null_level_is_no_baseline(df, fit):
    with pytest.raises(Exception, match="fixed level"):
        fit.predict(df.withColumn("f", F.lit(None).cast("string"))).collect()


def test_refit_keeps_subset_and_policy(df):
    data = df.withColumn("keep", F.col("x") < 0.8).withColumn("y", F.when(F.col("row_id") != "r3", F.col("y"))).withColumn("y2", F.col("y") * 2 + F.col("x"))
    first = lmm(data, "y ~ x + (1 | g)", subset="keep", na_action="omit")
    again = refit(first, "y2", data)
    fresh = lmm(data, "y2 ~ x + (1 | g)", subset="keep", na_action="omit")
    assert again.stats.n == first.stats.n < 60 and np.allclose(again.beta, fresh.beta, atol=1e-7) and abs(again.objective - fresh.objective) < 1e-7
    # other rows: all sums are made anew
    other = data.withColumn("y2", F.when(F.col("row_id") != "r10", F.col("y2")))
    assert abs(refit(first, "y2", other).objective - lmm(other, "y2 ~ x + (1 | g)", subset="keep", na_action="omit").objective) < 1e-7


def test_refit_of_two_factors_makes_only_the_sums_of_the_response(df):
    data = df.withColumn("y2", F.col("y") - F.col("x") ** 2)
    first = lmm(data, "y ~ x + (1 | g) + (1 | h)")
    fresh = lmm(data, "y2 ~ x + (1 | g) + (1 | h)")
    assert stats.with_response(first.stats, fresh.frame.rows, first.kept) is not None
    assert abs(refit(first, "y2", data).objective - fresh.objective) < 1e-6


def test_ambiguous_labels_are_refused(spark):
    rows = [(float(k), float(k % 3), *(("a:b", "c") if k % 2 else ("a", "b:c"))) for k in range(20)]
    data = spark.createDataFrame(rows, "y double, x double, p string, q string")
    with pytest.raises(SpecificationError, match="ambiguous"):
        lmm(data, "y ~ x + (1 | p:q)")


def test_means_that_rows_do_not_determine(df):
    data = df.withColumn("f2", F.when(F.col("f") == "b", "v").otherwise("u"))
    fit = lmm(data, "y ~ x + f + f2 + (1 | g)")
    assert len(fit.kept) < len(fit.names)
    means = grid.marginal_means(fit, data, ["f2"]).collect()
    assert len(means) == 2 and not any(r.estimable for r in means) and all(np.isnan(r.estimate) for r in means)


def test_pairs_stay_within_by(df):
    data = df.withColumn("k", F.when(F.col("h") == "h0", "s").otherwise("t"))
    fit = lmm(data, "y ~ x + f * k + (1 | g)")
    means = grid.marginal_means(fit, data, ["f", "k"])
    pairs = grid.pairwise(means, fit, "f", ["k"]).collect()
    est = {(r.f, r.k): r.estimate for r in means.collect()}
    assert len(pairs) == 6 and all(r.estimate == pytest.approx(est[r.level_1, r.k] - est[r.level_2, r.k]) for r in pairs)


def test_hypotheses_with_redundant_or_contradicting_rows(fit):
    two, three = [[0, 1, 0, 0], [0, 0, 1, 0]], [[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 1, 0]]
    for engine in (infer.satterthwaite(fit), infer.kenward_roger(fit)):
        a, b = engine.test(two), engine.test(three)
        assert (a.statistic, a.df1, a.df2) == pytest.approx((b.statistic, b.df1, b.df2), rel=1e-3) and b.status == "ok"
        assert engine.test(three, [0.0, 0.0, 1.0]).status == "inconsistent"
    assert infer.contrast(fit, three).statistic == pytest.approx(infer.contrast(fit, two).statistic)
    assert infer.contrast(fit, three, [0, 0, 1]).status == "inconsistent"


def test_limits_are_checked_before_sums_are_fetched(df, monkeypatch):
    monkeypatch.setattr(stats, "MOST_CELLS", 5)
    monkeypatch.setattr(stats, "products", lambda *a: pytest.fail("sums were asked for"))
    with pytest.raises(ResourceLimitError):
        lmm(df, "y ~ x + (1 | g)", sums="driver")


def test_fits_that_do_not_converge(df):
    with pytest.raises(ConvergenceError, match="evaluations"):
        lmm(df, "y ~ x + (1 + x | g)", control=FitControl(most_evaluations=4))
    found = lmm(df, "y ~ x + (1 + x | g)", control=FitControl(most_evaluations=4, on_failure="warn"))
    assert not found.converged and "4" in found.message and lmm(df, "y ~ x + (1 + x | g)").converged
    with pytest.raises(SpecificationError):
        FitControl(on_failure="ignore")


def test_sparse_crossed_sums_equal_dense_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{rng.integers(60)}", f"h{rng.integers(30)}", float(rng.normal()), float(rng.normal())) for _ in range(90)]
    fit = lmm(spark.createDataFrame(rows, "g string, h string, x double, y double"), "y ~ x + (1 | g) + (1 | h)", theta=np.array([0.7, 0.4]))
    s = fit.stats
    object.__setattr__(s, "sparse", None) if s.sparse is None else None
    assert s.sparse is not None
    sparse = pls.evaluate(s, np.array([0.7, 0.4]), True)
    s.__dict__["sparse"] = None
    dense = pls.evaluate(s, np.array([0.7, 0.4]), True)
    assert sparse.objective == pytest.approx(dense.objective, abs=1e-9) and np.allclose(sparse.beta, dense.beta) and all(np.allclose(a, b) for a, b in zip(sparse.b, dense.b, strict=True))


def test_post_fit_tables(spark, df, fit):
    post = PostFit.of(fit, "kenward_roger")
    rows = {r.name: r for r in post.coefficients(spark).collect()}
    t = infer.kenward_roger(fit).test([0, 1, 0, 0])
    half = t.std_error[0] * dist.t_ppf(0.975, t.df2)
    assert (rows["x"].estimate, rows["x"].df, rows["x"].p_value) == pytest.approx((fit.beta[1], t.df2, t.p_value))
    assert (rows["x"].lower, rows["x"].upper) == pytest.approx((fit.beta[1] - half, fit.beta[1] + half)) and rows["x"].status == "ok"
    means = {r.name: r.estimate for r in post.means(df, ["f"]).collect()}
    plain = {r.f: r.estimate for r in grid.marginal_means(fit, df, ["f"]).collect()}
    assert means == pytest.approx(plain)
    pairs = {r.name: r for r in post.differences(df, ["f"]).collect()}
    assert pairs["a - b"].estimate == pytest.approx(plain["a"] - plain["b"]) and all(r.p_adjusted >= r.p_value for r in pairs.values())
    one = post.summary(spark).first()
    assert one.aic == pytest.approx(fit.objective + 2 * (len(fit.kept) + 2)) and one.converged
    parts = {(r.term, r.kind): r.value for r in PostFit.of(lmm(df, "y ~ x + (1 + x | g)"), "asymptotic").variance_components(spark).where("name_2 is not null or term = 'Residual'").collect()}
    assert len(parts) == 2 and -1 <= parts["1 + x | g", "correlation"] <= 1 if ("1 + x | g", "correlation") in parts else len(parts) == 2
    with pytest.raises(SpecificationError):
        PostFit.of(fit, "guess")
    aliased = PostFit.of(lmm(df.withColumn("x2", F.col("x") * 2), "y ~ x + x2 + (1 | g)"), "asymptotic")
    assert [r.status for r in aliased.coefficients(spark).collect()].count("not_estimable") >= 1


def test_saved_models(spark, fit, tmp_path, monkeypatch):
    path = f"{tmp_path}/model"
    artifact.save(fit, spark, path)
    loaded = artifact.load(spark, path)
    for make in (infer.satterthwaite, infer.kenward_roger):
        with pytest.raises(SpecificationError, match="no sums"):
            make(loaded)
    body = json.loads(spark.read.parquet(path).first().body)
    for key, value in (("kept", [0, 9]), ("beta", [1.0]), ("sigma", 0.0), ("order", [1]), ("b", [[[0.0]]])):
        with pytest.raises(ArtifactError, match="fit each other"):
            artifact.check(body | {key: value})


def test_ledger_goes_on_and_refuses_other_jobs(spark, df, tmp_path):
    fit = lmm(df, "y ~ x + (1 | g)", row_id="row_id")
    path = f"{tmp_path}/ledger"
    ledger.bootstrap(fit, fit.frame.rows, 3, 5, "__id", path, at_once=2)
    with pytest.raises(IncompleteError, match="3 of 6"):
        simulate.complete(ledger.records(spark, path), 6)
    found = simulate.complete(ledger.bootstrap(fit, fit.frame.rows, 6, 5, "__id", path, at_once=4), 6, 1.0)
    whole = {r.replicate: r.sigma for r in simulate.bootstrap(fit, fit.frame.rows, 6, 5, "__id").collect()}
    assert {r.replicate: r.sigma for r in found.collect()} == pytest.approx(whole)
    with pytest.raises(LedgerError, match="another job"):
        ledger.bootstrap(fit, fit.frame.rows, 6, 6, "__id", path)
    with files.leased(spark, path), pytest.raises(LedgerError, match="works on"):
        ledger.bootstrap(fit, fit.frame.rows, 6, 5, "__id", path)
    assert simulate.complete(ledger.bootstrap(fit, fit.frame.rows, 6, 5, "__id", path), 6, 1.0).count() == 6
    open(f"{path}/_lock/{9:012d}", "w").close()
    with pytest.raises(LedgerError, match="works on"):
        ledger.bootstrap(fit, fit.frame.rows, 6, 5, "__id", path)


def test_a_dead_writers_lease_lapses_and_fences_it_off(spark, tmp_path):
    path = f"{tmp_path}/job"
    with files.leased(spark, path) as first:
        first.check()
        os.utime(f"{path}/_lock/{first.number:012d}", (1, 1))  # as if it had not been renewed since
        with files.leased(spark, path) as second:
            assert second.number > first.number
            second.check()
            first.renew()
            with pytest.raises(LedgerError, match="lapsed"):
                first.check()
        with pytest.raises(LedgerError, match="lapsed"):
            first.check()
    with files.leased(spark, path) as third:
        assert third.number > second.number
        os.utime(f"{path}/_lock/{third.number:012d}", (1, 1))
        third.renew()
        with pytest.raises(LedgerError, match="works on"), files.leased(spark, path):
            pass


def test_a_failed_overwrite_keeps_the_old_model(spark, fit, tmp_path):
    path = f"{tmp_path}/model"
    artifact.save(fit, spark, path)
    beta = artifact.load(spark, path).beta
    with pytest.raises(ArtifactError, match="exists"):
        artifact.save(fit, spark, path)
    with pytest.raises(RuntimeError), files.replaced(spark, path, True, ArtifactError) as folder:
        spark.range(3).write.parquet(folder)
        raise RuntimeError("killed")
    assert np.array_equal(artifact.load(spark, path).beta, beta) and os.listdir(tmp_path) == ["model"]
    # a writer that died between its two renames
    os.rename(path, f"{tmp_path}/_model.old-1")
    assert np.array_equal(artifact.load(spark, path).beta, beta)
    artifact.save(fit, spark, path, overwrite=True)
    assert np.array_equal(artifact.load(spark, path).beta, beta) and os.listdir(tmp_path) == ["model"]


def test_limits_precede_what_they_limit(spark, df, fit, monkeypatch):
    wide = spark.range(40).select(F.concat(F.lit("a"), F.col("id") % 4).alias("few"), F.col("id").cast("string").alias("many"))
    assert frame.observed_levels(wide, ["few", "few"]) == {"few": ["a0", "a1", "a2", "a3"]}
    assert frame.observed_levels(wide, ["few"], {"few": ["a3", "a9", "a0", "a1", "a2"]}) == {"few": ["a3", "a0", "a1", "a2"]}
    monkeypatch.setattr(frame, "MOST_LEVELS", 5)
    with pytest.raises(SpecificationError, match="many has more than 5"):
        frame.observed_levels(wide, ["few", "many"])
    means = grid.marginal_means(fit, df, ["f"])
    monkeypatch.setattr(grid, "MOST_MEANS", 1)
    with pytest.raises(ResourceLimitError, match="means are too many"):
        grid.pairwise(means, fit, "f")
