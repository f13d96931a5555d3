"""Bootstrap records in storage, so that a job can stop and go on.

A folder holds a manifest, a row with the fingerprint of the fit and the settings, and records, Parquet that is appended
to piece by piece. A job goes on only where the fingerprint is its own, makes only the replicates that are missing, and
holds a lease meanwhile, which lapses some minutes after a writer died; one that lost its lease stops before the next piece.
Draws depend on seed, replicate and row only, so a piece that was written twice has equal
records, of which one counts.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varicomp.errors import LedgerError
from varicomp.lmm import Fit
from varicomp.operators import simulate
from varicomp.sources import files

VERSION = 1


def fingerprint(fit: Fit, seed: int, row_id: str, mode: str) -> str:
    """Of all that decides the records but their number."""
    body = {"version": VERSION, "formula": asdict(fit.formula), "names": fit.names, "kept": fit.kept, "theta": fit.theta.tolist(), "sigma": fit.sigma, "beta": fit.beta.tolist(), "reml": fit.reml, "n": fit.stats.n, "yy": fit.stats.yy, "weights": fit.weights, "seed": seed, "row_id": row_id, "mode": mode}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def records(spark: SparkSession, path: str, of: str | None = None) -> DataFrame | None:
    """The records, each replicate once; None if there is no ledger. of: the fingerprint that they must have."""
    fs, at = files.at(spark, f"{path}/manifest/_SUCCESS")
    if not fs.exists(at):
        return None
    found = spark.read.schema("version int, fingerprint string").parquet(f"{path}/manifest").collect()
    if len(found) != 1 or found[0].version != VERSION or of not in (None, found[0].fingerprint):
        raise LedgerError(f"{path} holds the records of another job")
    if not fs.exists(files.at(spark, f"{path}/records")[1]):
        return spark.createDataFrame([], simulate.RECORD)
    return spark.read.schema(simulate.RECORD).parquet(f"{path}/records").dropDuplicates(["replicate"])


def bootstrap(fit: Fit, rows: DataFrame, replicates: int, seed: int, row_id: str, path: str, mode: str = "unconditional", at_once: int = 200, lease: float = 600.0) -> DataFrame:
    """Records of replicates 0 to replicates - 1, those in the folder and, written at_once at a time, those that were missing.
    lease: seconds after which a writer that does not renew its claim is taken to be dead."""
    spark, name = rows.sparkSession, fingerprint(fit, seed, row_id, mode)
    fs, at = files.at(spark, path)
    fs.mkdirs(at)
    with files.leased(spark, path, lease) as claim:
        if records(spark, path, name) is None:
            spark.createDataFrame([(VERSION, name)], "version int, fingerprint string").coalesce(1).write.parquet(f"{path}/manifest")
        for start in range(0, replicates, at_once):
            n = min(at_once, replicates - start)
            there = records(spark, path, name).where(F.col("replicate").between(start, start + n - 1)).select("replicate")
            if there.count() < n:
                claim.check()
                simulate.bootstrap(fit, rows, n, seed, row_id, mode, there, start).write.mode("append").parquet(f"{path}/records")
    return records(spark, path, name).where(F.col("replicate") < replicates)
