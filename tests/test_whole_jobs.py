"""Small cases in which a query of the library would do less than its whole job."""

import numpy as np
from pyspark.sql import functions as F

from varicomp import queries as library
from varicomp.lmm import lmm


def test_artifact_predicts_every_row(spark, tmp_path):
    rows = spark.range(1500).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 9).alias("l_suppkey"), (F.col("id") % 31).alias("l_partkey"), (1000 + F.col("id") * 37 % 911).cast("double").alias("l_extendedprice"), (F.col("id") % 50).alias("l_quantity"), F.lit(0.05).alias("l_discount"), F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = library.artifact_round_trip(spark, str(tmp_path))
    assert out.where("prediction is not null").select("row_id").distinct().count() == 1500


def test_crossed_fit_crosses_suppliers_and_parts(spark, tmp_path):
    k = F.col("id")
    price = 1000 + 500 * (k % 7) + 900 * F.sin(k % 11) + 40 * (k * 37 % 17)
    rows = spark.range(300).select(k.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (k % 7).alias("l_suppkey"), (k % 11).alias("l_partkey"), price.alias("l_extendedprice"), (k * 13 % 50).alias("l_quantity"), F.lit(0.05).alias("l_discount"), F.when(k % 3 == 0, "A").otherwise("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    fit = lambda h: [r.std_error for r in lmm(library.lines(spark, str(tmp_path)).withColumn("h", F.col(h)), "y ~ x + (1 | g) + (1 | h)").fixed_effects(spark).collect()]
    got = [r.std_error for r in library.crossed_fit(spark, str(tmp_path)).collect()]
    assert np.allclose(got, fit("h"), rtol=1e-6) and not np.allclose(got, fit("flag"), rtol=1e-2)
