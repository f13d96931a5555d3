"""A fit together with the inference that its tests, intervals and tables use."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from varicomp.errors import ResourceLimitError, SpecificationError
from varicomp.functions import distributions as dist
from varicomp.lmm import Fit
from varicomp.operators import grid, infer

METHODS = ("asymptotic", "satterthwaite", "kenward_roger", "CR0", "CR1", "CR2")
MOST_ROWS = 10_000
_TESTS = "name string, estimate double, std_error double, df double, statistic double, p_value double, lower double, upper double, status string"


@dataclass(frozen=True)
class PostFit:
    """test, contrasts, coefficients, means and differences share one method, chosen once."""

    fit: Fit
    method: str
    engine: object

    @classmethod
    def of(cls, fit: Fit, method: str = "satterthwaite", cluster: str | None = None) -> PostFit:
        if method not in METHODS:
            raise SpecificationError(f"method is one of {', '.join(METHODS)}")
        if cluster and method[:2] != "CR":
            raise SpecificationError("only the cluster-robust methods take a cluster")
        make = {"asymptotic": lambda: None, "satterthwaite": lambda: infer.satterthwaite(fit), "kenward_roger": lambda: infer.kenward_roger(fit)}
        return cls(fit, method, make[method]() if method in make else infer.cluster_robust(fit, cluster, method))

    def test(self, c, rhs=0.0) -> infer.Test:
        """Of one row or, jointly, of several; the status says why there is none."""
        return infer.contrast(self.fit, c, rhs) if self.engine is None else self.engine.test(c, rhs)

    def _row(self, name: str, c: np.ndarray, rhs: float, level: float) -> tuple:
        t = self.test(c, rhs)
        est, se = float(t.estimate[0]) + rhs, float(t.std_error[0])
        half = np.nan
        if t.status == "ok" and t.df2 > 0:
            half = se * (dist.t_ppf((1 + level) / 2, t.df2) if np.isfinite(t.df2) else dist.norm_ppf((1 + level) / 2))
        return name, est, se, float(t.df2), float(t.statistic), float(t.p_value), est - half, est + half, t.status

    def contrasts(self, spark: SparkSession, rows: dict[str, np.ndarray], rhs: float = 0.0, level: float = 0.95, adjust: str = "none") -> DataFrame:
        """A test and an interval for each named row of coefficients, and p_adjusted over all of them."""
        if len(rows) > MOST_ROWS:
            raise ResourceLimitError(f"more than {MOST_ROWS} contrasts")
        if not 0 < level < 1:
            raise SpecificationError("the level is between 0 and 1")
        out = spark.createDataFrame([self._row(n, np.asarray(c, float), rhs, level) for n, c in rows.items()], _TESTS)
        return grid.adjust(out, "p_value", adjust)

    def coefficients(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        """The fixed effects with tests; those that are not estimated have status not_estimable."""
        return self.contrasts(spark, dict(zip(self.fit.names, np.eye(len(self.fit.names)), strict=True)), level=level).drop("p_adjusted")

    def means(self, data: DataFrame, specs: list[str], weights: str = "equal", at: dict[str, list[float]] | None = None, level: float = 0.95, adjust: str = "none") -> DataFrame:
        """Marginal means with tests and intervals, by the names of their levels."""
        return self.contrasts(data.sparkSession, self._means(data, specs, weights, at), level=level, adjust=adjust)

    def differences(self, data: DataFrame, specs: list[str], weights: str = "equal", at: dict[str, list[float]] | None = None, level: float = 0.95, adjust: str = "holm") -> DataFrame:
        """Each pair of marginal means, once."""
        found = list(self._means(data, specs, weights, at).items())
        if len(found) * (len(found) - 1) // 2 > MOST_ROWS:
            raise ResourceLimitError(f"more than {MOST_ROWS} pairs")
        return self.contrasts(data.sparkSession, {f"{a} - {b}": x - y for k, (a, x) in enumerate(found) for b, y in found[k + 1 :]}, level=level, adjust=adjust)

    def _means(self, data: DataFrame, specs: list[str], weights: str, at: dict[str, list[float]] | None) -> dict[str, np.ndarray]:
        rows = grid.marginal_means(self.fit, data, specs, weights, at).orderBy(*specs).limit(MOST_ROWS + 1).collect()
        return {", ".join(str(r[s]) for s in specs): np.array([r[f"__l{k}"] for k in range(len(self.fit.names))]) for r in rows}

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row about the fit: rows, log-likelihood (restricted for REML), AIC, BIC, sigma, whether it converged and lies on the boundary."""
        f = self.fit
        n = len(f.kept) + len(f.theta) + 1
        log_lik = -f.objective / 2
        row = (f.stats.n, float(log_lik), float(2 * n - 2 * log_lik), float(np.log(f.stats.n) * n - 2 * log_lik), float(f.sigma), f.converged, f.message, f.boundary)
        return spark.createDataFrame([row], "nobs long, log_likelihood double, aic double, bic double, sigma double, converged boolean, message string, boundary boolean")

    def variance_components(self, spark: SparkSession) -> DataFrame:
        """Standard deviations and correlations of each term's random effects, and the residual's."""
        rows = []
        for k, t in enumerate(self.fit.stats.order):
            g, names = self.fit.covariances[k], self.fit.random_names[t]
            sd = np.sqrt(np.diag(g))
            for i, a in enumerate(names):
                rows.append((self.fit.formula.random[t].name, a, None, "sd", float(sd[i])))
                rows += [(self.fit.formula.random[t].name, names[j], a, "correlation", float(g[i, j] / (sd[i] * sd[j])) if sd[i] * sd[j] else float("nan")) for j in range(i)]
        return spark.createDataFrame([*rows, ("Residual", None, None, "sd", float(self.fit.sigma))], "term string, name_1 string, name_2 string, kind string, value double")
