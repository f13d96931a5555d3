"""Rank, aliases and estimability of fixed columns."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_library import SCHEMA, table

from varicomp import queries
from varicomp.errors import NumericalError, SpecificationError
from varicomp.lmm import lmm
from varicomp.operators import grid, rank


def r_of(x):
    return np.linalg.qr(x, mode="r")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 3), st.integers(-8, 8), st.integers(0, 10**6))
def test_aliases_give_the_dropped_columns_in_any_units(p, m, power, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, p))
    x = np.column_stack([x, x @ rng.integers(-3, 4, size=(p, m))])[:, rng.permutation(p + m)]
    x *= 10.0 ** rng.integers(min(power, 0), max(power, 0) + 1, size=p + m)
    found = rank.of(r_of(x), [f"c{k}" for k in range(p + m)])
    assert found.pivot == sorted(found.kept) + sorted(found.dropped) and len(found.kept) == np.linalg.matrix_rank(x / np.maximum(np.linalg.norm(x, axis=0), 1e-300))
    for j, d in enumerate(found.dropped):
        assert np.allclose(x[:, found.kept] @ found.aliases[:, j], x[:, d], rtol=0, atol=1e-9 * max(np.linalg.norm(x[:, d]), 1e-300))
    basis = found.basis()
    assert np.allclose(basis.T @ basis, np.eye(len(found.dropped)), atol=1e-10)
    assert all(found.is_estimable(row) for row in x)
    assert not any(found.is_estimable(np.eye(p + m)[d]) for d in found.dropped)


def test_a_near_alias_is_dropped_and_a_clear_one_is_not():
    x = np.column_stack([np.ones(96), np.arange(96.0), 2 * np.arange(96.0)])
    x[16, 2] += 1e-9
    found = rank.of(r_of(x), "1 x duplicate".split())
    assert found.dropped == [2] and found.is_estimable([0, 1, 2]) and not found.is_estimable([0, 1, 0])
    assert found.aliases[:, 0] == pytest.approx([0, 2], abs=1e-9)
    x[16, 2] += 1
    assert rank.of(r_of(x), "1 x duplicate".split()).dropped == []


def test_odd_input():
    found = rank.of(r_of(np.column_stack([np.ones(5), np.zeros(5)])), ["1", "zero"])
    assert found.dropped == [1] and found.aliases.tolist() == [[0.0]] and not found.is_estimable([0, 1]) and found.is_estimable([1, 0])
    assert found.is_estimable([0, 0])
    with pytest.raises(SpecificationError):
        found.is_estimable([1, 0, 0])
    with pytest.raises(SpecificationError):
        found.is_estimable([1, np.nan])
    with pytest.raises(SpecificationError):
        rank.of(np.full((2, 2), np.inf), ["a", "b"])
    with pytest.raises(NumericalError):
        rank.of(r_of(np.random.default_rng(1).normal(size=(9, 3))), ["a", "b", "c"], kept=[0, 1])


def test_large_units_leave_everything_estimable(spark):
    df = spark.createDataFrame(table(), SCHEMA).withColumn("x", F.col("x") * 1e9)
    fit = lmm(df, "y ~ x + f + (1 | g)", theta=np.array([0.5]))
    assert fit.rank.dropped == [] and fit.is_estimable([1, 0, 0, 0]) and fit.is_estimable([0, 1, 0, 0])
    assert fit.predict(df).where("not estimable or isnan(prediction)").count() == 0
    means = grid.marginal_means(fit, df, ["f"]).collect()
    assert means and all(m["estimable"] and not np.isnan(m["estimate"]) for m in means)


def test_dependent_columns_in_small_units_are_checked_row_by_row(spark):
    df = spark.createDataFrame(table(), SCHEMA).withColumn("tiny", F.col("x") * 1e-8)
    fit = lmm(df, "y ~ x + tiny + (1 | g)", theta=np.array([0.5]))
    assert fit.rank.dropped == [2] and fit.predict(df).where("not estimable").count() == 0
    new = df.withColumn("tiny", F.when(F.col("row_id") == "r1", F.col("tiny") + 1e-8).otherwise(F.col("tiny")))
    assert [r["row_id"] for r in fit.predict(new).where("not estimable").collect()] == ["r1"]


def test_alias_table_by_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    ours = sorted(tuple(r) for r in queries.QUERIES["alias_table"](spark, folder).select("dropped", "name", "coefficient").collect())
    assert ours == sorted(con.execute(queries.ORACLE["alias_table"]).fetchall()) and len(ours) == 6
