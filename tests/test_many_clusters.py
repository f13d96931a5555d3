"""CR2's degrees of freedom from sums over clusters, which stay on executors."""

import types

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_library import SCHEMA, table

from varicomp.lmm import lmm
from varicomp.operators import infer


def by_pairs(cr2, l):
    """From the matrix of all pairs of clusters."""
    b, q = cr2.fit.point.s_inv, len(l)
    h = np.einsum("sp,cpk,kr->csr", l @ b, cr2.ex, np.linalg.cholesky(b))
    p = -np.einsum("ask,btk->stab", h, h)
    at = np.arange(len(h))
    p[:, :, at, at] += np.einsum("sp,cpr,tr->stc", l @ b, cr2.ete, l @ b)
    d, u = np.linalg.eigh(np.einsum("staa->st", p))
    root = (u / np.sqrt(d)) @ u.T
    p = np.einsum("us,vt,stab->uvab", root, root, p)
    own = np.einsum("ssab->sab", p)
    return q * (q + 1) / (np.einsum("stab,tsab->", p, p) + np.einsum("sab,tab->", own, own))


def many(spark, n):
    """n clusters with made-up blocks; a matrix of their pairs would have n * n cells."""
    x = [F.sin(F.col("id") * (k + 1)) for k in range(4)]
    ete = F.array(*[F.lit(2.0) + x[0], x[1] / 9, x[1] / 9, F.lit(3.0) + x[2]])
    blocks = spark.range(n).select(F.array(x[0], x[1]).alias("score"), F.array(*[c / n for c in x]).alias("ex"), (ete).alias("ete"))
    fit = types.SimpleNamespace(point=types.SimpleNamespace(s_inv=np.array([[0.5, 0.1], [0.1, 0.25]])))
    return infer.ClusterRobust(fit, "CR2", np.eye(2), n, blocks)


@pytest.mark.parametrize("rows", [[[0, 1]], [[1, 0]]])
def test_one_row_with_many_clusters(spark, rows):
    l = np.array(rows, float)
    few = many(spark, 200)
    assert few._htz(l) == pytest.approx(by_pairs(few, l), rel=1e-9)
    lots = many(spark, 300_000)
    lb = (l @ lots.fit.point.s_inv)[0]
    h = np.einsum("p,cpk,kr->cr", lb, lots.ex, np.linalg.cholesky(lots.fit.point.s_inv))
    e = np.einsum("p,cpr,r->c", lb, lots.ete, lb)
    own = (h * h).sum(axis=1)
    total = (e**2).sum() - 2 * (e * own).sum() + ((h.T @ h) ** 2).sum()
    assert lots._htz(l) == pytest.approx((e - own).sum() ** 2 / total, rel=1e-9)


def test_a_fit_with_one_row(spark):
    fit = lmm(spark.createDataFrame(table(), SCHEMA), "y ~ x + f + (1 | g)", theta=np.array([0.8]))
    cr2 = infer.cluster_robust(fit, kind="CR2")
    for l in ([[0, 1, 0, 0]], [[1, 2, -1, 0]]):
        assert cr2.test(l).df2 == pytest.approx(by_pairs(cr2, np.array(l, float)), rel=1e-9)
    assert cr2.clusters == 6 and "_fetched" in vars(cr2)  # by the comparison above only
    fresh = infer.cluster_robust(fit, kind="CR2")
    fresh.test([0, 1, 0, 0])
    assert "_fetched" not in vars(fresh)


def test_several_rows_with_many_clusters(spark):
    few, l = many(spark, 200), np.array([[1.0, 0.5], [0.0, 1.0]])
    assert few._htz(l) == pytest.approx(by_pairs(few, l), rel=1e-9)
    # the test has no coordinates: other rows of the same hypothesis have the same degrees of freedom
    lots = many(spark, 300_000)
    assert lots._htz(l) == pytest.approx(lots._htz(np.array([[1.0, 2.0], [3.0, -1.0]])), rel=1e-9)


def test_a_fit_with_several_rows(spark):
    fit = lmm(spark.createDataFrame(table(), SCHEMA), "y ~ x + f + (1 | g)", theta=np.array([0.8]))
    cr2, l = infer.cluster_robust(fit, kind="CR2"), np.array([[0, 1, 0, 0], [0, 0, 1, 1.0]])
    t = cr2.test(l)
    assert t.df2 == pytest.approx(by_pairs(cr2, l) - 1, rel=1e-9)


def test_clusters_of_several_sizes_across_batches(spark):
    """Blocks do not depend on where batches end; clusters have 1 to 12 rows and hold several groups."""
    rows = [(f"{i}", f"{i % 13 * (i % 13 + 1) // 2 + i % (i % 13 + 1)}", f"c{i % 13}", float(i % 7), float(i * i % 31)) for i in range(180)]
    df = spark.createDataFrame(rows, "row_id string, g string, c string, x double, y double")
    fit = lmm(df, "y ~ x + (1 | g)", theta=np.array([0.7]))
    one = infer.cluster_robust(fit, "c", "CR2")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        two = infer.cluster_robust(lmm(df, "y ~ x + (1 | g)", theta=np.array([0.7])), "c", "CR2")
        two.test([0, 1])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert one.clusters == two.clusters == 13
    assert one.vcov == pytest.approx(two.vcov, rel=1e-9) and one.test(np.eye(2)).df2 == pytest.approx(two.test(np.eye(2)).df2, rel=1e-9)
