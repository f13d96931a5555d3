"""Group sums that grow with a stream: they are mergeable, so each batch adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_sums(rows: DataFrame, group: str, response: str, covariate: str) -> DataFrame:
    y, x = F.col(f"`{response}`"), F.col(f"`{covariate}`")
    return rows.groupBy(F.col(f"`{group}`").alias("level")).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))


def appender(path: str, group: str, response: str, covariate: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each batch's sums under its number, so that a batch done again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch_sums(batch, group, response, covariate).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def merged(sums: DataFrame) -> DataFrame:
    names = ("n", "sx", "sy", "sxx", "sxy", "syy")
    return sums.groupBy("level").agg(*[F.sum(c).alias(c) for c in names])
