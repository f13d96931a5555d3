"""Ordinary and weighted least squares on the same sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicomp.functions import distributions as dist


@dataclass(frozen=True)
class Linear:
    names: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    sigma: float
    df: int

    def test(self, c) -> tuple[float, float, float]:
        """Estimate, t, two-sided p."""
        est, se = float(np.dot(c, self.beta)), float(np.sqrt(np.dot(c, self.vcov @ c)))
        return est, est / se, 2 * dist.t_sf(abs(est / se), self.df)


def ols(df: DataFrame, response: str, columns: list[str], weights: str | None = None) -> Linear:
    """With an intercept; one aggregation, after one for the means that the sums are centred at."""
    w = F.col(f"`{weights}`").cast("double") if weights else F.lit(1.0)
    xs = [F.col(f"`{c}`").cast("double") for c in columns]
    mean = df.agg(F.sum(w * F.col(response)) / F.sum(w), *[F.sum(w * x) / F.sum(w) for x in xs]).first()
    z = [x - F.lit(m) for x, m in zip(xs, mean[1:], strict=True)] + [F.col(f"`{response}`") - F.lit(mean[0])]
    n = len(z)
    row = df.agg(F.count("*"), F.sum(w), *[F.sum(w * z[i] * z[j]) for i in range(n) for j in range(i, n)]).first()
    g = np.zeros((n, n))
    g[np.triu_indices(n)] = row[2:]
    g = np.triu(g) + np.triu(g, 1).T
    inv = np.linalg.inv(g[:-1, :-1]) if columns else np.zeros((0, 0))
    slope = inv @ g[:-1, -1]
    dof = row[0] - n
    s2 = float(g[-1, -1] - slope @ g[:-1, -1]) / dof
    m = np.array(mean[1:])
    v = np.zeros((n, n))
    v[1:, 1:] = inv
    v[0, 1:] = v[1:, 0] = -inv @ m
    v[0, 0] = 1 / row[1] + m @ inv @ m
    return Linear(["(Intercept)", *columns], np.r_[mean[0] - m @ slope, slope], s2 * v, float(np.sqrt(s2)), dof)
