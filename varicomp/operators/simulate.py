"""Simulation and parametric bootstrap. Draws depend on seed, replicate and row or level only, never on partitions."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varicomp.errors import IncompleteError, SpecificationError
from varicomp.functions import distributions as dist
from varicomp.lmm import Fit, minimise
from varicomp.operators import pls


def normal(seed: int, purpose: str, *keys: Column) -> Column:
    """A standard normal deviate for the keys: two hashes, then Box and Muller."""
    uniform = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(purpose), F.lit(k), *keys), 11) + 0.5) / F.lit(float(2**53))
    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def simulate(fit: Fit, rows: DataFrame, replicates: int, seed: int, row_id: str, mode: str = "unconditional", start: int = 0) -> DataFrame:
    """rows (a frame's, with row_id) for each replicate, and __sim, a drawn response less offset and shift."""
    if len(fit.stats.order) > 1:
        raise SpecificationError("one grouping factor is supported")
    (lam,) = pls.factors(fit.theta, fit.stats.sizes)
    k = len(lam)
    beta = fit.beta.copy()
    beta[0] -= fit.stats.shift
    out = rows.withColumn("replicate", F.explode(F.sequence(F.lit(start), F.lit(start + replicates - 1)).cast("array<long>")))
    mean = reduce(lambda a, b: a + b, [F.lit(float(b)) * F.col(f"__x{j}") for j, b in zip(fit.kept, beta, strict=True)])
    if mode == "unconditional":
        u = [normal(seed, f"level{j}", F.col("replicate"), F.col("__g0")) for j in range(k)]
        random = reduce(lambda a, b: a + b, [F.col(f"__z0_{i}") * F.lit(float(fit.sigma * lam[i, j])) * u[j] for i in range(k) for j in range(i + 1)])
    elif mode == "conditional":
        table = rows.sparkSession.createDataFrame([(lv, *map(float, b)) for lv, b in zip(fit.stats.labels[0], fit.point.b[0], strict=True)], ", ".join(["__g0 string", *[f"__b{j} double" for j in range(k)]]))
        out = out.join(table, "__g0")
        random = reduce(lambda a, b: a + b, [F.col(f"__z0_{j}") * F.col(f"__b{j}") for j in range(k)])
    else:
        raise SpecificationError("mode is unconditional or conditional")
    noise = F.lit(float(fit.sigma)) / F.sqrt("__w") * normal(seed, "row", F.col("replicate"), F.col(row_id))
    return out.withColumn("__sim", mean + random + noise)


RECORD = "replicate long, status string, theta array<double>, sigma double, beta array<double>, objective double"


def bootstrap(fit: Fit, rows: DataFrame, replicates: int, seed: int, row_id: str, mode: str = "unconditional", done: DataFrame | None = None, start: int = 0) -> DataFrame:
    """A refit for each replicate (status ok, singular or failed); done: records not to make again.

    Draws are summed by replicate and level before anything leaves a task; a refit sees sums only.
    """
    k, p = fit.stats.a.shape[1], fit.stats.p
    drawn = simulate(fit, rows, replicates, seed, row_id, mode, start)
    if done is not None:
        drawn = drawn.join(F.broadcast(done.select("replicate").distinct()), "replicate", "left_anti")
    w, s = F.col("__w"), F.col("__sim")
    sums = [F.sum(w * F.col(f"__z0_{j}") * s).alias(f"f{j}") for j in range(k)] + [F.sum(w * F.col(f"__x{j}") * s).alias(f"t{i}") for i, j in enumerate(fit.kept)] + [F.sum(w * s * s).alias("yy")]
    levels = drawn.groupBy("replicate", "__g0").agg(*sums)
    base, reml, labels = fit.stats, fit.reml, fit.stats.labels[0]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.set_index("__g0").loc[labels]
        found = replace(base, f=pdf[[f"f{j}" for j in range(k)]].to_numpy(), rf=pdf[[f"t{j}" for j in range(p)]].to_numpy().sum(axis=0), yy=float(pdf["yy"].sum()))
        number = int(pdf["replicate"].iloc[0])
        try:
            point, _ = minimise(found, reml)
        except (ArithmeticError, np.linalg.LinAlgError):
            return pd.DataFrame({"replicate": [number], "status": ["failed"], "theta": [None], "sigma": [np.nan], "beta": [None], "objective": [np.nan]})
        edge = bool((point.theta[pls.lower_bounds(found.sizes) == 0] == 0).any())
        return pd.DataFrame({"replicate": [number], "status": ["singular" if edge else "ok"], "theta": [point.theta.tolist()], "sigma": [point.sigma], "beta": [point.beta.tolist()], "objective": [point.objective]})

    return levels.groupBy("replicate").applyInPandas(one, RECORD)


def complete(records: DataFrame, replicates: int, most_failures: float = 0.0) -> DataFrame:
    """records, if each replicate is there once and at most this share failed; else an error. Failed ones are left out."""
    n, different, outside, bad = records.agg(F.count("*"), F.count_distinct("replicate"), F.count_if((F.col("replicate") < 0) | (F.col("replicate") >= replicates)), F.count_if(F.col("status") == "failed")).first()
    if n != replicates or different != replicates or outside:
        raise IncompleteError(f"{different} of {replicates} replicates are there, in {n} records")
    if bad > most_failures * replicates:
        raise IncompleteError(f"{bad} of {replicates} replicates failed")
    return records.where("status != 'failed'")


def interval(draws: DataFrame, value: str, level: float = 0.95, method: str = "percentile", estimate: float = 0.0) -> DataFrame:
    """lower and upper; quantiles interpolate linearly between order statistics."""
    a = (1 - level) / 2
    lo, hi = F.percentile(value, F.lit(a)), F.percentile(value, F.lit(1 - a))
    if method == "basic":
        lo, hi = F.lit(2 * estimate) - hi, F.lit(2 * estimate) - lo
    elif method != "percentile":
        raise SpecificationError("method is percentile or basic")
    return draws.where(F.col(value).isNotNull()).agg(lo.alias("lower"), hi.alias("upper"), F.count("*").alias("n"))


def failure_bound(records: DataFrame, confidence: float = 0.95) -> tuple[int, int, float]:
    """Replicates, failures, and the exact upper bound of the share of failures."""
    n, bad = records.agg(F.count("*"), F.sum((F.col("status") == "failed").cast("int"))).first()
    bad = bad or 0
    return n, bad, 1.0 if bad == n else dist.beta_ppf(confidence, bad + 1, n - bad)
