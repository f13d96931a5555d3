"""Reference grids, marginal means, pairwise contrasts, and adjustment of p-values."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varicomp.errors import ResourceLimitError, SpecificationError
from varicomp.lmm import Fit

MOST_CELLS = 100_000
MOST_MEANS = 2_000  # that are compared with each other, some 2 million pairs
SCHEMES = ("equal", "proportional", "outer", "cells", "flat")


def cell_weights(data: DataFrame, grid: DataFrame, specs: list[str], nuisance: list[str], scheme: str) -> DataFrame:
    """grid with __weight; the rows of data are counted once, however many there are."""
    everything = [*specs, *nuisance]
    if scheme == "equal" or not everything:
        return grid.withColumn("__weight", F.lit(1.0))
    if scheme in ("cells", "flat"):
        counts = data.groupBy(*everything).count()
        weight = F.coalesce(F.col("count"), F.lit(0))
        out = grid.join(counts, everything, "left").withColumn("__weight", (weight if scheme == "cells" else (weight > 0)).cast("double"))
        return out.drop("count")
    if not nuisance:
        return grid.withColumn("__weight", F.lit(1.0))
    if scheme == "proportional":
        out = grid.join(data.groupBy(*nuisance).count(), nuisance, "left")
        return out.withColumn("__weight", F.coalesce("count", F.lit(0)).cast("double")).drop("count")
    if scheme != "outer":
        raise SpecificationError(f"weights are one of {', '.join(SCHEMES)}")
    out = grid.withColumn("__weight", F.lit(1.0))
    for v in nuisance:
        out = out.join(data.groupBy(v).count(), v, "left").withColumn("__weight", F.col("__weight") * F.coalesce("count", F.lit(0))).drop("count")
    return out


def marginal_means(fit: Fit, data: DataFrame, specs: list[str], weights: str = "equal", at: dict[str, list[float]] | None = None) -> DataFrame:
    """specs, estimate, std_error, estimable: grid rows averaged over the other categorical variables; numeric ones at their
    means. A mean that the rows do not determine is NaN. To keep variables apart (by), name them in specs."""
    spark = data.sparkSession
    used = list(dict.fromkeys(v for t in fit.encoder.terms for v in t))
    cats = [v for v in used if v in fit.encoder.levels]
    numeric = [v for v in used if v not in cats]
    at = at or {}
    means = data.agg(*[F.avg(f"`{v}`").alias(v) for v in numeric]).first() if numeric else {}
    values = {v: (fit.encoder.levels[v] if v in cats else at.get(v) or [float(means[v])]) for v in used}
    size = reduce(lambda a, b: a * b, map(len, values.values()), 1)
    if size > MOST_CELLS:
        raise ResourceLimitError("the reference grid is too large")
    rows = list(product(*values.values()))
    grid = spark.createDataFrame([tuple(x if isinstance(x, str) else float(x) for x in r) for r in rows], ", ".join(f"`{v}` {'string' if v in cats else 'double'}" for v in used)) if used else spark.range(1).select()
    nuisance = [v for v in cats if v not in specs]
    grid = cell_weights(data, grid, [s for s in specs if s in cats], nuisance, weights)
    cols = fit.encoder.columns()
    mean = [(F.sum(F.col("__weight") * c) / F.sum("__weight")).alias(f"__l{k}") for k, (_, c) in enumerate(cols)]
    out = grid.groupBy(*specs).agg(*mean)
    est = reduce(lambda a, b: a + b, [F.lit(float(b)) * F.col(f"__l{k}") for k, b in zip(fit.kept, fit.beta, strict=True)])
    v = fit.vcov
    var = reduce(lambda a, b: a + b, [F.lit(float(v[i, j])) * F.col(f"__l{a}") * F.col(f"__l{b}") for i, a in enumerate(fit.kept) for j, b in enumerate(fit.kept)])
    ok = fit.rank.determined([F.col(f"__l{k}") for k in range(len(cols))])
    nan = F.lit(float("nan"))
    return out.select(*specs, *[f"__l{k}" for k in range(len(cols))], F.when(ok, est).otherwise(nan).alias("estimate"), F.when(ok, F.sqrt(var)).otherwise(nan).alias("std_error"), ok.alias("estimable"))


def pairwise(means: DataFrame, fit: Fit, key: str, by: list[str] | None = None) -> DataFrame:
    """Each pair of marginal means, within each combination of by: by, level_1, level_2, estimate, std_error. A grid is
    small by its own limit. A difference of means can be determined where the means are not."""
    by, every = by or [], range(len(fit.names))
    largest = means.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest > MOST_MEANS:
        raise ResourceLimitError(f"{largest} means are too many to compare each with each; at most {MOST_MEANS}")
    a = means.select(*by, F.col(f"`{key}`").alias("level_1"), *[F.col(f"__l{k}").alias(f"__a{k}") for k in every])
    b = means.select(*by, F.col(f"`{key}`").alias("level_2"), *[F.col(f"__l{k}").alias(f"__b{k}") for k in every])
    both = a.join(b, by).where("level_1 < level_2") if by else a.join(b, F.col("level_1") < F.col("level_2"))
    d = {k: F.col(f"__a{k}") - F.col(f"__b{k}") for k in fit.kept}
    est = reduce(lambda x, y: x + y, [F.lit(float(c)) * d[k] for k, c in zip(fit.kept, fit.beta, strict=True)])
    v = fit.vcov
    var = reduce(lambda x, y: x + y, [F.lit(float(v[i, j])) * d[p] * d[q] for i, p in enumerate(fit.kept) for j, q in enumerate(fit.kept)])
    ok = fit.rank.determined([F.col(f"__a{k}") - F.col(f"__b{k}") for k in every])
    nan = F.lit(float("nan"))
    return both.select(*by, "level_1", "level_2", F.when(ok, est).otherwise(nan).alias("estimate"), F.when(ok, F.sqrt(var)).otherwise(nan).alias("std_error"))


def adjust(tests: DataFrame, p: str = "p_value", method: str = "holm", by: list[str] | None = None) -> DataFrame:
    """tests with p_adjusted; the number of tests counts all, also those without a p-value."""
    by = by or []
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    m = F.count(F.lit(1)).over(every)
    if method == "none":
        return tests.withColumn("p_adjusted", F.col(p))
    if method == "bonferroni":
        return tests.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * m))
    if method == "sidak":
        return tests.withColumn("p_adjusted", -F.expm1(m * F.log1p(-F.col(p))))
    if method != "holm":
        raise SpecificationError("method is none, bonferroni, sidak or holm")
    ranked = every.orderBy(F.col(p).asc_nulls_last())
    raw = (m - F.row_number().over(ranked) + 1) * F.col(p)
    out = tests.withColumn("__raw", raw)
    return out.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("__raw").over(ranked.rowsBetween(Window.unboundedPreceding, 0))))).drop("__raw")
