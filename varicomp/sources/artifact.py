"""Prediction-only models in storage: one checked JSON document in a Parquet file, without any training row."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from varicomp.errors import ArtifactError
from varicomp.lmm import Fit
from varicomp.operators.frame import Encoder
from varicomp.operators.pls import Point, factors
from varicomp.operators.stats import Stats
from varicomp.plans.formula import Formula, RandomTerm
from varicomp.sources import files

VERSION = 1
MOST_BYTES = 64_000_000


def save(fit: Fit, spark: SparkSession, path: str, overwrite: bool = False) -> None:
    body = json.dumps({
        "version": VERSION, "formula": asdict(fit.formula), "encoder": asdict(fit.encoder), "random_encoder": asdict(fit.random_encoder), "random_names": fit.random_names, "names": fit.names, "kept": fit.kept,
        "r": fit.r.tolist(), "order": fit.stats.order, "sizes": fit.stats.sizes, "labels": fit.stats.labels, "theta": fit.theta.tolist(), "beta": fit.beta.tolist(), "b": [x.tolist() for x in fit.point.b],
        "sigma": fit.sigma, "objective": fit.objective, "s_inv": fit.point.s_inv.tolist(), "reml": fit.reml, "offset": fit.offset, "n": fit.stats.n, "p": fit.stats.p,
    }, sort_keys=True, allow_nan=False)
    if len(body) > MOST_BYTES:
        raise ArtifactError("the model is too large to save as one document")
    row = (body, hashlib.sha256(body.encode()).hexdigest())
    with files.replaced(spark, path, overwrite, ArtifactError) as folder:
        spark.createDataFrame([row], "body string, sha256 string").coalesce(1).write.parquet(folder)


def check(d: dict) -> None:
    """Refuses a document whose parts do not fit each other."""
    p, k = len(d["names"]), len(d["kept"])
    widths = [len(z) for z in d["random_names"]]
    wrong = (
        sorted(set(d["kept"])) != d["kept"] or not all(0 <= j < p for j in d["kept"]) or len(d["beta"]) != k or d["p"] != k or np.shape(d["s_inv"]) != (k, k)
        or sorted(d["order"]) != list(range(len(widths))) or len(d["formula"]["random"]) != len(widths) or len(d["labels"]) != len(widths) or not d["sigma"] > 0
        or any(len(set(lv)) != len(lv) for lv in d["labels"]) or [np.shape(b) for b in d["b"]] != [(len(lv), widths[t]) for lv, t in zip(d["labels"], d["order"], strict=True)]
        or any(sum(parts) != widths[t] for parts, t in zip(d["sizes"], d["order"], strict=True)) or np.shape(d["r"])[-1] != p
    )
    if wrong:
        raise ArtifactError("the parts of the saved model do not fit each other")
    factors(np.array(d["theta"]), d["sizes"])


def load(spark: SparkSession, path: str) -> Fit:
    files.restored(spark, path)
    found = spark.read.schema("body string, sha256 string").parquet(path)
    # sizes first: a document over the limit is not fetched
    sizes = found.select(F.octet_length("body")).limit(2).collect()
    if len(sizes) != 1 or not sizes[0][0] or sizes[0][0] > MOST_BYTES:
        raise ArtifactError("not a saved model")
    rows = found.collect()
    if hashlib.sha256(rows[0].body.encode()).hexdigest() != rows[0].sha256:
        raise ArtifactError("the saved model is damaged")
    d = json.loads(rows[0].body)
    if d["version"] != VERSION:
        raise ArtifactError(f"version {d['version']} is not supported")
    f = d["formula"]
    formula = Formula(f["response"], tuple(map(tuple, f["fixed"])), tuple(f["offsets"]), tuple(RandomTerm(tuple(t["group"]), t["slope"], t["correlated"]) for t in f["random"]))
    encoder, random_encoder = (Encoder(tuple(map(tuple, e["terms"])), e["levels"], e["coding"]) for e in (d["encoder"], d["random_encoder"]))
    check(d)
    none = np.zeros(0)
    stats = Stats(d["labels"], d["sizes"], none, none, none, none, none, 0.0, 0.0, d["n"], d["p"], 0.0, d["order"])
    point = Point(np.array(d["theta"]), d["objective"], np.array(d["beta"]), [], [np.array(b) for b in d["b"]], 0.0, d["sigma"], 0.0, 0.0, np.array(d["s_inv"]), 0.0)
    if not all(np.isfinite(x).all() for x in (point.theta, point.beta, point.s_inv, *point.b)):
        raise ArtifactError("the saved model has values that are not finite")
    return Fit(formula, encoder, random_encoder, tuple(map(tuple, d["random_names"])), d["names"], d["kept"], np.array(d["r"]), stats, point, d["reml"], 0, d["offset"])
