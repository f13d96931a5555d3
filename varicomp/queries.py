"""Registered queries of the mixed-model library and the SQL they are held against.

The response has a deterministic group signal: the tables' own groups have almost no variance between them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varicomp.errors import SpecificationError
from varicomp.lmm import Fit, lmm, refit
from varicomp.operators import frame, grid, infer, linear, postfit, profile, rank, simulate, stats
from varicomp.plans import formula
from varicomp.sources import artifact, ledger

THETA = 0.8
MAIN = "y ~ x + (1 | g)"
FACTORIAL = "y ~ x + flag * status + (1 | g)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship input: one row a line item, suppliers as groups."""
    signal = F.col("l_extendedprice") / 1000 + 8 * F.sin(F.col("l_suppkey") * 0.7)
    return _table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"), F.col("l_suppkey").cast("string").alias("g"), F.col("l_partkey").cast("string").alias("h"), signal.alias("y"),
        F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("d"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (1 + F.col("l_quantity") % 3).alias("w"),
    )


def _frame(spark, sf_dir, text=MAIN, **options) -> frame.Frame:
    return frame.build(lines(spark, sf_dir), formula.parse(text), **options)


def _fit(spark, sf_dir, text=MAIN, **options) -> Fit:
    return lmm(lines(spark, sf_dir), text, **options)


def _r(c, d: int = 6):
    return F.round(c, d)


def flagship(spark, sf_dir) -> DataFrame:
    fit = _fit(spark, sf_dir)
    return fit.fixed_effects(spark).select("name", _r("estimate").alias("estimate"), _r("std_error").alias("std_error"))


def status_counts(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("x", F.when(F.col("x") < 48, F.col("x"))).withColumn("keep", F.col("d") > 0.01)
    return rows.groupBy(frame.row_status(rows, ["y", "x", "g"], "keep").alias("row_status")).agg(F.count("*").alias("n"))


def complete_cases(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("x", F.when(F.col("x") < 10, F.col("x"))).withColumn("keep", F.col("d") > 0.05)
    f = frame.build(rows, formula.parse(MAIN), subset="keep", na_action="omit")
    return f.rows.groupBy("__g0").agg(F.count("*").alias("n"), _r(F.sum("__x1")).alias("sx")).withColumnRenamed("__g0", "g")


def _coded(spark, sf_dir, contrasts=None) -> DataFrame:
    f = _frame(spark, sf_dir, FACTORIAL, contrasts=contrasts)
    names = [n for n, _ in f.encoder.columns()]
    return f.rows.agg(*[_r(F.sum(F.col(f"__x{k}") * F.col("__y")), 3).alias("s_" + n.replace(":", "_").replace("(", "").replace(")", "").lower()) for k, n in enumerate(names)])


def encode_treatment(spark, sf_dir) -> DataFrame:
    return _coded(spark, sf_dir)


def encode_sum(spark, sf_dir) -> DataFrame:
    return _coded(spark, sf_dir, {"flag": "sum", "status": "sum"})


def levels_observed(spark, sf_dir) -> DataFrame:
    found = frame.observed_levels(lines(spark, sf_dir), ["flag", "status"])
    return spark.createDataFrame([(v, k, x) for v, ls in found.items() for k, x in enumerate(ls)], "variable string, place long, level string")


def nested_labels(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").join(F.broadcast(_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return rows.groupBy(frame.group_label(("segment", "nation")).alias("label")).agg(F.count("*").alias("n"))


def sums_single(spark, sf_dir) -> DataFrame:
    f = _frame(spark, sf_dir, weights="w")
    out = stats.products(f.rows.withColumn("__r", F.col("__y")), ["__g0"], [("__z0_0", "__z0_0"), ("__z0_0", "__x1"), ("__z0_0", "__r")])
    return out.select(F.col("__g0").alias("g"), *[_r(f"s{k}", 4).alias(n) for k, n in enumerate(("sw", "swx", "swy"))])


def sums_slope(spark, sf_dir) -> DataFrame:
    f = _frame(spark, sf_dir, "y ~ x + (1 + x | g)")
    out = stats.products(f.rows.withColumn("__r", F.col("__y")), ["__g0"], [("__z0_0", "__z0_1"), ("__z0_1", "__z0_1"), ("__z0_1", "__r")])
    return out.select(F.col("__g0").alias("g"), *[_r(f"s{k}", 4).alias(n) for k, n in enumerate(("sx", "sxx", "sxy"))])


def sums_crossed(spark, sf_dir) -> DataFrame:
    f = _frame(spark, sf_dir, "y ~ x + (1 | g) + (1 | h)")
    out = stats.products(f.rows, ["__g0", "__g1"], [("__z0_0", "__z1_0")])
    return out.select(F.col("__g0").alias("g"), F.col("__g1").alias("h"), F.col("s0").cast("long").alias("n"))


def gram_global(spark, sf_dir) -> DataFrame:
    f = _frame(spark, sf_dir)
    out = stats.products(f.rows, [], [("__x0", "__x0"), ("__x0", "__x1"), ("__x1", "__x1"), ("__x1", "__y"), ("__y", "__y")])
    return out.select(*[_r(f"s{k}", 2).alias(n) for k, n in enumerate(("n", "sx", "sxx", "sxy", "syy"))])


def _at_theta(spark, sf_dir, reml: bool, **options) -> DataFrame:
    p = _fit(spark, sf_dir, reml=reml, theta=np.array([THETA]), **options).point
    row = tuple(round(float(v), 5) for v in (p.objective, p.beta[0], p.beta[1], p.sigma, np.sqrt(p.vcov[1, 1])))
    return spark.createDataFrame([row], "objective double, beta0 double, beta1 double, sigma double, se1 double")


def deviance_ml(spark, sf_dir) -> DataFrame:
    return _at_theta(spark, sf_dir, False)


def deviance_reml(spark, sf_dir) -> DataFrame:
    return _at_theta(spark, sf_dir, True)


def executor_deviance(spark, sf_dir) -> DataFrame:
    """deviance_reml with the sums by level on executors."""
    return _at_theta(spark, sf_dir, True, sums="executors")


def coupled_deviance(spark, sf_dir) -> DataFrame:
    """deviance_ml through a factor of all random effects: its covariance is that of THETA, its columns are turned by a
    reflection, so that levels are coupled on the way."""
    from varicomp.operators import pls

    s = _fit(spark, sf_dir, reml=False, theta=np.array([THETA]), sums="driver").stats
    q = len(s.labels[0])
    p = pls.at_coupled(s, np.array([THETA]), np.full((q, 1), -2 * THETA / q), np.ones((q, 1)), False)
    row = tuple(round(float(v), 5) for v in (p.objective, p.beta[0], p.beta[1], p.sigma, np.sqrt(p.vcov[1, 1])))
    return spark.createDataFrame([row], "objective double, beta0 double, beta1 double, sigma double, se1 double")


def deviance_grid(spark, sf_dir) -> DataFrame:
    """The best of a grid of covariance parameters."""
    from varicomp.operators import pls

    s = _fit(spark, sf_dir, reml=False, theta=np.array([THETA])).stats
    return spark.createDataFrame([(float(t / 20),) for t in [min(range(1, 61), key=lambda t: pls.evaluate(s, [t / 20], False).objective)]], "theta double")


def random_effects(spark, sf_dir) -> DataFrame:
    return _fit(spark, sf_dir, reml=False, theta=np.array([THETA])).random_effects(spark).select(F.col("level").alias("g"), _r("u", 5).alias("u"), _r("b", 5).alias("b"))


def executor_effects(spark, sf_dir) -> DataFrame:
    return _fit(spark, sf_dir, reml=False, theta=np.array([THETA]), sums="executors").random_effects(spark).select(F.col("level").alias("g"), _r("u", 5).alias("u"), _r("b", 5).alias("b"))


def residuals(spark, sf_dir) -> DataFrame:
    fit = _fit(spark, sf_dir, reml=False, theta=np.array([THETA]))
    return fit.with_residuals(lines(spark, sf_dir)).groupBy("flag").agg(F.count("*").alias("n"), _r(F.sum(F.col("residual") ** 2) / F.count("*"), 5).alias("mse"), _r(F.avg("fitted"), 5).alias("mean_fitted"))


def _new_rows(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).withColumn("g", F.when(F.col("x") > 40, F.concat(F.lit("new-"), "g")).otherwise(F.col("g")))


def predict_population(spark, sf_dir) -> DataFrame:
    fit = _fit(spark, sf_dir, reml=False, theta=np.array([THETA]))
    return fit.predict(lines(spark, sf_dir), "population").groupBy("flag").agg(_r(F.avg("prediction"), 5).alias("mean_prediction"))


def predict_new_groups(spark, sf_dir) -> DataFrame:
    fit = _fit(spark, sf_dir, reml=False, theta=np.array([THETA]))
    return fit.predict(_new_rows(spark, sf_dir), allow_new_groups=True).groupBy("new_group").agg(F.count("*").alias("n"), _r(F.avg("prediction"), 5).alias("mean_prediction"))


def _grid_weights(scheme: str) -> Callable:
    def run(spark, sf_dir) -> DataFrame:
        rows = lines(spark, sf_dir)
        cells = rows.select("flag").distinct().join(rows.select("status").distinct())
        weighed = grid.cell_weights(rows, cells, ["flag"], ["status"], scheme)
        total = F.sum("__weight")
        return weighed.groupBy("flag").agg(_r(F.sum(F.col("__weight") * F.when(F.col("status") == "O", 1.0).otherwise(0.0)) / total, 9).alias("share_open"), _r(total, 3).alias("weight"))

    return run


def marginal_means(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir)
    fit = lmm(rows, "y ~ x + flag + (1 | g)", reml=False, theta=np.array([THETA]))
    return grid.marginal_means(fit, rows, ["flag"]).select("flag", _r("estimate", 5).alias("estimate"), _r("std_error", 6).alias("std_error"))


def pairwise_contrasts(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir)
    fit = lmm(rows, "y ~ x + flag + (1 | g)", reml=False, theta=np.array([THETA]))
    return grid.pairwise(grid.marginal_means(fit, rows, ["flag"]), fit, "flag").select("level_1", "level_2", _r("estimate", 5).alias("estimate"), _r("std_error", 6).alias("std_error"))


def _p_values(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") * 7 % 25 + 1) / 400).alias("p_value"))


def _adjust(method: str) -> Callable:
    def run(spark, sf_dir) -> DataFrame:
        return grid.adjust(_p_values(spark, sf_dir), method=method).select("n_nationkey", _r("p_adjusted", 10).alias("p_adjusted"))

    return run


def performance(spark, sf_dir) -> DataFrame:
    fit = _fit(spark, sf_dir, reml=False, theta=np.array([THETA]))
    out = infer.performance(fit, lines(spark, sf_dir))
    return out.select("nobs", *[_r(c, 5).alias(c) for c in ("fixed_variance", "random_variance", "residual_variance", "r2_marginal", "icc")])


def nestedness(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("g"), F.col("s_nationkey").alias("c"))
    return spark.createDataFrame([(infer.nested(rows, "g", "c"), infer.nested(rows, "c", "g"))], "group_in_cluster boolean, cluster_in_group boolean")


def _robust(kind: str) -> Callable:
    def run(spark, sf_dir) -> DataFrame:
        fit = _fit(spark, sf_dir, reml=False, theta=np.array([THETA]))
        v = infer.cluster_robust(fit, kind=kind).vcov
        return spark.createDataFrame([tuple(round(float(x), 7) for x in (v[0, 0], v[0, 1], v[1, 1]))], "v00 double, v01 double, v11 double")

    return run


def _draws(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "customer").select((F.sin(F.col("c_custkey") * 1.7) + F.cos(F.col("c_custkey") * 0.3)).alias("value"))


def _interval(method: str) -> Callable:
    def run(spark, sf_dir) -> DataFrame:
        return simulate.interval(_draws(spark, sf_dir), "value", 0.9, method, 0.25).select(_r("lower", 8).alias("lower"), _r("upper", 8).alias("upper"), "n")

    return run


def ols_fit(spark, sf_dir) -> DataFrame:
    m = linear.ols(lines(spark, sf_dir), "y", ["x", "d"])
    return spark.createDataFrame([(n, round(float(b), 7), round(float(np.sqrt(v)), 7)) for n, b, v in zip(m.names, m.beta, np.diag(m.vcov), strict=True)], "name string, estimate double, std_error double")


def alias_table(spark, sf_dir) -> DataFrame:
    """What the fixed columns that depend on others equal."""
    rows = lines(spark, sf_dir).withColumns({"a": 2 * F.col("x") + 3, "b": F.col("x") - 4 * F.col("d")})
    found = frame.build(rows, formula.parse("y ~ x + d + a + b + (1 | g)"))
    names = [n for n, _ in found.encoder.columns()]
    r = stats.r_factor(found.rows, [f"__x{k}" for k in range(len(names))])
    return rank.of(r, names).table(spark).withColumn("coefficient", _r("coefficient") + F.lit(0.0))


# without SQL: iterative or not expressible; tests hold these against closed forms and dense algebra


def satterthwaite(spark, sf_dir) -> DataFrame:
    t = infer.satterthwaite(_fit(spark, sf_dir)).test([0, 1])
    return spark.createDataFrame([(t.status, float(t.estimate[0]), float(t.std_error[0]), float(t.df2), float(t.p_value))], "status string, estimate double, std_error double, df double, p_value double")


def kenward_roger(spark, sf_dir) -> DataFrame:
    t = infer.kenward_roger(_fit(spark, sf_dir)).test([0, 1])
    return spark.createDataFrame([(t.status, float(t.estimate[0]), float(t.statistic), float(t.df2), float(t.p_value))], "status string, estimate double, f double, df double, p_value double")


def crossed_fit(spark, sf_dir) -> DataFrame:
    return _fit(spark, sf_dir, "y ~ x + (1 | g) + (1 | h)").fixed_effects(spark)


def slope_fit(spark, sf_dir) -> DataFrame:
    return _fit(spark, sf_dir, "y ~ x + (1 + x | g)", reml=False).fixed_effects(spark)


def refit_response(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("y2", F.col("y") * 2 + 1)
    return refit(lmm(rows, MAIN), "y2", rows).fixed_effects(spark)


def profile_interval(spark, sf_dir) -> DataFrame:
    lo, hi = infer.profile_interval(_fit(spark, sf_dir, reml=False), "x")
    return spark.createDataFrame([("x", lo, hi)], "name string, lower double, upper double")


def cr2_test(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir)
    t = infer.cluster_robust(lmm(rows, "y ~ x + (1 | h)", theta=np.array([0.5])), kind="CR2").test([0, 1])
    return spark.createDataFrame([(float(t.estimate[0]), float(t.std_error[0]), float(t.df2), float(t.p_value))], "estimate double, std_error double, df double, p_value double")


def robust_htz(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir)
    t = infer.cluster_robust(lmm(rows, "y ~ x + (1 | h)", theta=np.array([0.5])), kind="CR2").test(np.eye(2))
    return spark.createDataFrame([(t.status, float(t.statistic), float(t.df1), float(t.df2), float(t.p_value))], "status string, f double, df1 double, df2 double, p_value double")


def profile_traces(spark, sf_dir) -> DataFrame:
    return profile.points(spark, profile.likelihood_profile(_fit(spark, sf_dir, reml=False)))


def profile_all(spark, sf_dir) -> DataFrame:
    return profile.intervals(spark, profile.likelihood_profile(_fit(spark, sf_dir, reml=False)))


def bootstrap(spark, sf_dir) -> DataFrame:
    fit = _fit(spark, sf_dir, row_id="row_id")
    return simulate.bootstrap(fit, fit.frame.rows, 20, 7, "__id")


def _folder(spark, name: str) -> str:
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise SpecificationError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="varicomp-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ledger_resume(spark, sf_dir) -> DataFrame:
    """A bootstrap of 12 replicates after one of 5 in the same folder: each replicate once, and how many failed."""
    fit, path = _fit(spark, sf_dir, row_id="row_id"), _folder(spark, "ledger")
    ledger.bootstrap(fit, fit.frame.rows, 5, 7, "__id", path, at_once=3)
    found = simulate.complete(ledger.bootstrap(fit, fit.frame.rows, 12, 7, "__id", path, at_once=5), 12)
    return found.select("replicate", (F.col("status") == "failed").cast("int").alias("failed"))


def postfit_coefficients(spark, sf_dir) -> DataFrame:
    """z tests and intervals of the model at a fixed theta."""
    fit = _fit(spark, sf_dir, theta=np.array([THETA]), reml=False)
    return postfit.PostFit.of(fit, "asymptotic").coefficients(spark).select("name", _r("estimate").alias("estimate"), _r("std_error").alias("std_error"), _r("lower", 5).alias("lower"), _r("upper", 5).alias("upper"), "status")


def postfit_differences(spark, sf_dir) -> DataFrame:
    return postfit.PostFit.of(_fit(spark, sf_dir, "y ~ x + flag + (1 | g)"), "kenward_roger").differences(lines(spark, sf_dir), ["flag"])


def postfit_summary(spark, sf_dir) -> DataFrame:
    return postfit.PostFit.of(_fit(spark, sf_dir, reml=False), "asymptotic").summary(spark)


def artifact_round_trip(spark, sf_dir) -> DataFrame:
    path = _folder(spark, "model")
    artifact.save(_fit(spark, sf_dir), spark, path)
    return artifact.load(spark, path).predict(lines(spark, sf_dir)).select("row_id", "prediction")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (status_counts, complete_cases, encode_treatment, encode_sum, levels_observed, nested_labels, sums_single, sums_slope, sums_crossed, gram_global, deviance_ml, deviance_reml, executor_deviance, coupled_deviance, deviance_grid, random_effects, executor_effects, residuals, predict_population, predict_new_groups, marginal_means, pairwise_contrasts, performance, nestedness, ledger_resume, ols_fit, alias_table, satterthwaite, kenward_roger, crossed_fit, slope_fit, refit_response, profile_interval, profile_all, profile_traces, cr2_test, robust_htz, bootstrap, artifact_round_trip, postfit_coefficients, postfit_differences, postfit_summary)}
QUERIES |= {"lmm_reml": flagship}
QUERIES |= {f"grid_{s}": _grid_weights(s) for s in grid.SCHEMES}
QUERIES |= {f"adjust_{m}": _adjust(m) for m in ("none", "holm", "bonferroni", "sidak")}
QUERIES |= {f"robust_{k.lower()}": _robust(k) for k in ("CR0", "CR1")}
QUERIES |= {f"interval_{m}": _interval(m) for m in ("percentile", "basic")}

_L = """l AS (SELECT l_suppkey::VARCHAR AS g, l_partkey::VARCHAR AS h, l_extendedprice / 1000 + 8 * sin(l_suppkey * 0.7) AS y, l_quantity::DOUBLE AS x,
  l_discount::DOUBLE AS d, l_returnflag AS flag, l_linestatus AS status, 1 + l_quantity % 3 AS w FROM lineitem)"""
_T2 = THETA * THETA
#: The fit at THETA: sums by group, then the system with the random intercepts eliminated. Responses are centred.
_F = f"""{_L}, m AS (SELECT avg(y) AS y0 FROM l), c AS (SELECT g, x, flag, y - y0 AS r, y, y0 FROM l, m),
  gs AS (SELECT g, count(*)::DOUBLE AS a, sum(x) AS bx, sum(r) AS s, sum(x * x) AS xx, sum(x * r) AS xr, sum(r * r) AS rr, 1 + {_T2} * count(*) AS cc FROM c GROUP BY g),
  e AS (SELECT sum(a - {_T2} * a * a / cc) AS s00, sum(bx - {_T2} * a * bx / cc) AS s01, sum(xx - {_T2} * bx * bx / cc) AS s11, sum(s - {_T2} * a * s / cc) AS t0,
    sum(xr - {_T2} * bx * s / cc) AS t1, sum(rr - {_T2} * s * s / cc) AS q, sum(ln(cc)) AS ldc, sum(a) AS n FROM gs),
  f AS (SELECT *, (s11 * t0 - s01 * t1) / (s00 * s11 - s01 * s01) AS b0, (s00 * t1 - s01 * t0) / (s00 * s11 - s01 * s01) AS b1, s00 * s11 - s01 * s01 AS det FROM e),
  fit AS (SELECT *, q - t0 * b0 - t1 * b1 AS rss FROM f),
  ranef AS (SELECT g, {THETA} * (s - b0 * a - b1 * bx) / cc AS u, {_T2} * (s - b0 * a - b1 * bx) / cc AS b FROM gs, fit)"""


def _deviance_sql(reml: bool) -> str:
    nu = "(n - 2)" if reml else "n"
    return f"""WITH {_F} SELECT round(ldc + {'ln(det)' if reml else '0'} + {nu} * (1 + ln(2 * pi() * rss / {nu})), 5) AS objective, round(b0 + y0, 5) AS beta0, round(b1, 5) AS beta1,
      round(sqrt(rss / {nu}), 5) AS sigma, round(sqrt(rss / {nu} * s00 / det), 5) AS se1 FROM fit, m"""


def _robust_sql(factor: str) -> str:
    return f"""WITH {_F}, sc AS (SELECT s - b0 * a - b1 * bx - {_T2} * a / cc * (s - b0 * a - b1 * bx) AS k0, xr - b0 * bx - b1 * xx - {_T2} * bx / cc * (s - b0 * a - b1 * bx) AS k1 FROM gs, fit),
      k AS (SELECT sum(k0 * k0) * {factor} AS m00, sum(k0 * k1) * {factor} AS m01, sum(k1 * k1) * {factor} AS m11 FROM sc),
      i AS (SELECT s11 / det AS i00, -s01 / det AS i01, s00 / det AS i11 FROM fit)
      SELECT round(i00 * i00 * m00 + 2 * i00 * i01 * m01 + i01 * i01 * m11, 7) AS v00, round(i00 * i01 * m00 + (i00 * i11 + i01 * i01) * m01 + i01 * i11 * m11, 7) AS v01,
        round(i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11, 7) AS v11 FROM k, i"""


def _grid_sql(weight: str) -> str:
    return f"""WITH {_L}, cells AS (SELECT * FROM (SELECT DISTINCT flag FROM l), (SELECT DISTINCT status FROM l)),
      k AS (SELECT c.flag, c.status, coalesce((SELECT count(*) FROM l WHERE l.flag = c.flag AND l.status = c.status), 0) AS cell, (SELECT count(*) FROM l WHERE l.status = c.status) AS margin FROM cells c)
      SELECT flag, round(sum({weight} * (status = 'O')::INT)::DOUBLE / sum({weight}), 9) AS share_open, round(sum({weight})::DOUBLE, 3) AS weight FROM k GROUP BY flag"""


#: One more fixed effect: flag N and R against A, solved by elimination of x and the indicators in turn (a 4 by 4 system).
_M = f"""{_L}, m AS (SELECT avg(y) AS y0 FROM l), c AS (SELECT g, 1.0::DOUBLE AS x0, x AS x1, (flag = 'N')::INT::DOUBLE AS x2, (flag = 'R')::INT::DOUBLE AS x3, y - y0 AS x4 FROM l, m),
  lng AS (SELECT g, i, sum(v) AS s FROM (SELECT g, unnest([0, 1, 2, 3, 4]) AS i, unnest([x0, x1, x2, x3, x4]) AS v FROM c) GROUP BY g, i),
  cr AS (SELECT i, j, sum(v) AS v FROM (SELECT unnest([0,0,0,0,0,1,1,1,1,1,2,2,2,2,2,3,3,3,3,3,4,4,4,4,4]) AS i, unnest([0,1,2,3,4,0,1,2,3,4,0,1,2,3,4,0,1,2,3,4,0,1,2,3,4]) AS j,
    unnest([x0*x0,x0*x1,x0*x2,x0*x3,x0*x4,x1*x0,x1*x1,x1*x2,x1*x3,x1*x4,x2*x0,x2*x1,x2*x2,x2*x3,x2*x4,x3*x0,x3*x1,x3*x2,x3*x3,x3*x4,x4*x0,x4*x1,x4*x2,x4*x3,x4*x4]) AS v FROM c) GROUP BY i, j),
  el AS (SELECT a.i, b.j, sum(a.s * b.s * {_T2} / (1 + {_T2} * n.s)) AS v FROM lng a JOIN (SELECT g, i AS j, s FROM lng) b USING (g) JOIN (SELECT g, s FROM lng WHERE i = 0) n USING (g) GROUP BY a.i, b.j),
  k0 AS (SELECT i, j, cr.v - el.v AS v FROM cr JOIN el USING (i, j) UNION ALL SELECT i, 5 + j, (i = j)::INT::DOUBLE FROM range(4) a(i), range(4) b(j))"""


def _sweep(k: int) -> str:
    """Gauss-Jordan on pivot k of the rows i and columns j of k<k>; columns 5 to 8 become the inverse."""
    return f", k{k + 1} AS (SELECT a.i, a.j, CASE WHEN a.i = {k} THEN r.v / p.v ELSE a.v - c.v * r.v / p.v END AS v FROM k{k} a JOIN k{k} r ON r.i = {k} AND r.j = a.j JOIN k{k} c ON c.j = {k} AND c.i = a.i JOIN k{k} p ON p.i = {k} AND p.j = {k})"


_M += "".join(_sweep(k) for k in range(4)) + f"""
  , b AS (SELECT i, v AS b FROM k4 WHERE j = 4 AND i < 4), inv AS (SELECT i, j - 5 AS j, v FROM k4 WHERE j > 4 AND i < 4),
  s2 AS (SELECT (SELECT v FROM k4 WHERE i = 4 AND j = 4) / (SELECT count(*) FROM l) AS s2),
  lf AS (SELECT flag, i, v FROM (SELECT f.flag, unnest([0, 1, 2, 3]) AS i, unnest([1.0, (SELECT avg(x) FROM l), (f.flag = 'N')::INT, (f.flag = 'R')::INT]) AS v FROM (SELECT DISTINCT flag FROM l) f))"""

ORACLE: dict[str, str] = {
    "status_counts": f"WITH {_L} SELECT CASE WHEN NOT d > 0.01 THEN 'excluded' WHEN x >= 48 THEN 'omitted' ELSE 'retained' END AS row_status, count(*) AS n FROM l GROUP BY 1",
    "complete_cases": f"WITH {_L} SELECT g, count(*) AS n, round(sum(x), 6) AS sx FROM l WHERE d > 0.05 AND x < 10 GROUP BY g",
    "encode_treatment": f"WITH {_L} SELECT round(sum(y), 3) AS s_intercept, round(sum(x * y), 3) AS s_x, round(sum(y * (flag = 'N')::INT), 3) AS \"s_flagn\", round(sum(y * (flag = 'R')::INT), 3) AS s_flagr, round(sum(y * (status = 'O')::INT), 3) AS s_statuso, round(sum(y * (flag = 'N' AND status = 'O')::INT), 3) AS s_flagn_statuso, round(sum(y * (flag = 'R' AND status = 'O')::INT), 3) AS s_flagr_statuso FROM l",
    "encode_sum": f"WITH {_L}, k AS (SELECT *, (flag = 'A')::INT - (flag = 'R')::INT AS f1, (flag = 'N')::INT - (flag = 'R')::INT AS f2, (status = 'F')::INT - (status = 'O')::INT AS o FROM l) SELECT round(sum(y), 3) AS s_intercept, round(sum(x * y), 3) AS s_x, round(sum(y * f1), 3) AS s_flag1, round(sum(y * f2), 3) AS s_flag2, round(sum(y * o), 3) AS s_status1, round(sum(y * f1 * o), 3) AS s_flag1_status1, round(sum(y * f2 * o), 3) AS s_flag2_status1 FROM k",
    "levels_observed": "SELECT 'flag' AS variable, row_number() OVER (ORDER BY v) - 1 AS place, v AS level FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem) UNION ALL SELECT 'status', row_number() OVER (ORDER BY v) - 1, v FROM (SELECT DISTINCT l_linestatus AS v FROM lineitem)",
    "nested_labels": "SELECT c_mktsegment || ':' || n_name AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "sums_single": f"WITH {_L} SELECT g, round(sum(w)::DOUBLE, 4) AS sw, round(sum(w * x), 4) AS swx, round(sum(w * y), 4) AS swy FROM l GROUP BY g",
    "sums_slope": f"WITH {_L} SELECT g, round(sum(x), 4) AS sx, round(sum(x * x), 4) AS sxx, round(sum(x * y), 4) AS sxy FROM l GROUP BY g",
    "sums_crossed": f"WITH {_L} SELECT g, h, count(*) AS n FROM l GROUP BY g, h",
    "gram_global": f"WITH {_L} SELECT count(*)::DOUBLE AS n, round(sum(x), 2) AS sx, round(sum(x * x), 2) AS sxx, round(sum(x * y), 2) AS sxy, round(sum(y * y), 2) AS syy FROM l",
    "deviance_ml": _deviance_sql(False),
    "coupled_deviance": _deviance_sql(False),
    "deviance_reml": _deviance_sql(True),
    "executor_deviance": _deviance_sql(True),
    "deviance_grid": f"""WITH {_L}, m AS (SELECT avg(y) AS y0 FROM l), c AS (SELECT g, x, y - y0 AS r FROM l, m), gs AS (SELECT g, count(*)::DOUBLE AS a, sum(x) AS bx, sum(r) AS s, sum(x * x) AS xx, sum(x * r) AS xr, sum(r * r) AS rr FROM c GROUP BY g),
      th AS (SELECT i / 20.0::DOUBLE AS theta FROM range(1, 61) t(i)),
      e AS (SELECT theta, sum(a - theta^2 * a * a / (1 + theta^2 * a)) AS s00, sum(bx - theta^2 * a * bx / (1 + theta^2 * a)) AS s01, sum(xx - theta^2 * bx * bx / (1 + theta^2 * a)) AS s11, sum(s - theta^2 * a * s / (1 + theta^2 * a)) AS t0,
        sum(xr - theta^2 * bx * s / (1 + theta^2 * a)) AS t1, sum(rr - theta^2 * s * s / (1 + theta^2 * a)) AS q, sum(ln(1 + theta^2 * a)) AS ldc, sum(a) AS n FROM gs, th GROUP BY theta)
      SELECT arg_min(theta, ldc + n * ln((q - (s11 * t0 * t0 - 2 * s01 * t0 * t1 + s00 * t1 * t1) / (s00 * s11 - s01 * s01)) / n))::DOUBLE AS theta FROM e""",
    "random_effects": f"WITH {_F} SELECT g, round(u, 5) AS u, round(b, 5) AS b FROM ranef",
    "executor_effects": f"WITH {_F} SELECT g, round(u, 5) AS u, round(b, 5) AS b FROM ranef",
    "residuals": f"WITH {_F}, p AS (SELECT flag, y, y0 + b0 + b1 * x + b AS fitted FROM c JOIN ranef USING (g), fit) SELECT flag, count(*) AS n, round(sum((y - fitted) ^ 2) / count(*), 5) AS mse, round(avg(fitted), 5) AS mean_fitted FROM p GROUP BY flag",
    "predict_population": f"WITH {_F} SELECT flag, round(avg(y0 + b0 + b1 * x), 5) AS mean_prediction FROM c, fit GROUP BY flag",
    "predict_new_groups": f"WITH {_F} SELECT x > 40 AS new_group, count(*) AS n, round(avg(y0 + b0 + b1 * x + CASE WHEN x > 40 THEN 0 ELSE b END), 5) AS mean_prediction FROM c JOIN ranef USING (g), fit GROUP BY 1",
    "grid_equal": _grid_sql("1"),
    "grid_proportional": _grid_sql("margin"),
    "grid_outer": _grid_sql("margin"),
    "grid_cells": _grid_sql("cell"),
    "grid_flat": _grid_sql("(cell > 0)::INT"),
    "marginal_means": f"WITH {_M} SELECT flag, round(sum(lf.v * b) + any_value(y0), 5) AS estimate, round(sqrt(any_value(s2) * any_value((SELECT sum(x.v * z.v * inv.v) FROM lf x JOIN lf z ON x.flag = z.flag JOIN inv ON inv.i = x.i AND inv.j = z.i WHERE x.flag = lf.flag))), 6) AS std_error FROM lf JOIN b USING (i), m, s2 GROUP BY flag",
    "pairwise_contrasts": f"WITH {_M}, d AS (SELECT p.flag AS level_1, q.flag AS level_2, i, p.v - q.v AS v FROM lf p JOIN lf q USING (i) WHERE p.flag < q.flag) SELECT level_1, level_2, round(sum(d.v * b), 5) AS estimate, round(sqrt(any_value(s2) * any_value((SELECT sum(x.v * z.v * inv.v) FROM d x JOIN d z ON x.level_1 = z.level_1 AND x.level_2 = z.level_2 JOIN inv ON inv.i = x.i AND inv.j = z.i WHERE x.level_1 = d.level_1 AND x.level_2 = d.level_2))), 6) AS std_error FROM d JOIN b USING (i), s2 GROUP BY level_1, level_2",
    "performance": f"WITH {_F}, v AS (SELECT n::BIGINT AS nobs, (SELECT var_pop(b1 * x) FROM c, fit) AS fv, {_T2} * rss / n AS rv, rss / n AS ev FROM fit) SELECT nobs, round(fv, 5) AS fixed_variance, round(rv, 5) AS random_variance, round(ev, 5) AS residual_variance, round(fv / (fv + rv + ev), 5) AS r2_marginal, round(rv / (rv + ev), 5) AS icc FROM v",
    "nestedness": "SELECT (SELECT max(n) <= 1 FROM (SELECT count(DISTINCT s_nationkey) AS n FROM supplier GROUP BY s_suppkey)) AS group_in_cluster, (SELECT max(n) <= 1 FROM (SELECT count(DISTINCT s_suppkey) AS n FROM supplier GROUP BY s_nationkey)) AS cluster_in_group",
    "robust_cr0": _robust_sql("1"),
    "robust_cr1": _robust_sql("count(*) / (count(*) - 1)"),
    "ledger_resume": "SELECT unnest(range(12))::BIGINT AS replicate, 0::INT AS failed",
    "ols_fit": f"""WITH {_L}, m AS (SELECT avg(y) AS y0, avg(x) AS x0, avg(d) AS d0, count(*) AS n FROM l), s AS (SELECT sum((x - x0)^2) AS xx, sum((d - d0)^2) AS dd, sum((x - x0) * (d - d0)) AS xd, sum((x - x0) * (y - y0)) AS xy, sum((d - d0) * (y - y0)) AS dy, sum((y - y0)^2) AS yy FROM l, m),
      b AS (SELECT *, xx * dd - xd * xd AS det, (dd * xy - xd * dy) / (xx * dd - xd * xd) AS bx, (xx * dy - xd * xy) / (xx * dd - xd * xd) AS bd FROM s, m), v AS (SELECT *, (yy - bx * xy - bd * dy) / (n - 3) AS s2 FROM b)
      SELECT 'x' AS name, round(bx, 7) AS estimate, round(sqrt(s2 * dd / det), 7) AS std_error FROM v UNION ALL SELECT 'd', round(bd, 7), round(sqrt(s2 * xx / det), 7) FROM v
      UNION ALL SELECT '(Intercept)', round(y0 - bx * x0 - bd * d0, 7), round(sqrt(s2 * (1.0 / n + (x0 * x0 * dd - 2 * x0 * d0 * xd + d0 * d0 * xx) / det)), 7) FROM v""",
}
ORACLE["alias_table"] = f"""WITH {_L}, k AS (SELECT x, d, 2 * x + 3 AS a, x - 4 * d AS b FROM l), m AS (SELECT avg(x) AS x0, avg(d) AS d0, avg(a) AS a0, avg(b) AS b0 FROM k),
  s AS (SELECT sum((x - x0)^2) AS xx, sum((d - d0)^2) AS dd, sum((x - x0) * (d - d0)) AS xd, unnest(['a', 'b']) AS dropped, unnest([sum((x - x0) * (a - a0)), sum((x - x0) * (b - b0))]) AS xz, unnest([sum((d - d0) * (a - a0)), sum((d - d0) * (b - b0))]) AS dz FROM k, m),
  c AS (SELECT dropped, (dd * xz - xd * dz) / (xx * dd - xd * xd) AS cx, (xx * dz - xd * xz) / (xx * dd - xd * xd) AS cd FROM s)
  SELECT dropped, unnest(['(Intercept)', 'x', 'd']) AS name, round(unnest([CASE dropped WHEN 'a' THEN a0 ELSE b0 END - cx * x0 - cd * d0, cx, cd]), 6) + 0.0 AS coefficient FROM c, m"""
_PV = "p AS (SELECT n_nationkey, (n_nationkey * 7 % 25 + 1) / 400 AS p, count(*) OVER () AS m FROM nation)"
ORACLE |= {
    "adjust_none": f"WITH {_PV} SELECT n_nationkey, round(p, 10) AS p_adjusted FROM p",
    "adjust_bonferroni": f"WITH {_PV} SELECT n_nationkey, round(least(1, p * m), 10) AS p_adjusted FROM p",
    "adjust_sidak": f"WITH {_PV} SELECT n_nationkey, round(1 - (1 - p) ^ m, 10) AS p_adjusted FROM p",
    "adjust_holm": f"WITH {_PV}, r AS (SELECT *, (m - row_number() OVER (ORDER BY p) + 1) * p AS raw FROM p) SELECT n_nationkey, round(least(1, max(raw) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)), 10) AS p_adjusted FROM r",
    "interval_percentile": "WITH v AS (SELECT sin(c_custkey * 1.7) + cos(c_custkey * 0.3) AS v FROM customer) SELECT round(quantile_cont(v, 0.05), 8) AS lower, round(quantile_cont(v, 0.95), 8) AS upper, count(*) AS n FROM v",
    "interval_basic": "WITH v AS (SELECT sin(c_custkey * 1.7) + cos(c_custkey * 0.3) AS v FROM customer) SELECT round(0.5 - quantile_cont(v, 0.95), 8) AS lower, round(0.5 - quantile_cont(v, 0.05), 8) AS upper, count(*) AS n FROM v",
}
