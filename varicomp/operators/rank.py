"""Which fixed columns can be estimated, what the others equal, and which linear functions the rows determine.

All from the R factor, whose columns have the lengths and angles of the rows' own. A column that depends on the kept ones
before it, to within the tolerance, moves to the end; the order is otherwise the formula's. Tests are in columns of length 1,
so units of measurement do not matter: a column in billions beside an intercept is no dependency.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varicomp.errors import NumericalError, SpecificationError
from varicomp.operators.stats import independent_columns

TOLERANCE = 1e-7
ROW_TOLERANCE = 1e-6  # for single rows, which deviate more than a whole column does


@dataclass(frozen=True)
class Rank:
    names: tuple[str, ...]
    kept: list[int]
    dropped: list[int]
    aliases: np.ndarray  # (kept, dropped): each dropped column as a combination of the kept ones
    norms: np.ndarray  # of the columns; 1 for a column of zeros
    directions: np.ndarray  # orthonormal, (columns, dropped), for coefficients of columns of length 1

    @property
    def pivot(self) -> list[int]:
        return [*self.kept, *self.dropped]

    def basis(self) -> np.ndarray:
        """Orthonormal directions of the coefficients that no row tells apart."""
        plain = self.directions / self.norms[:, None]
        return np.linalg.qr(plain / np.linalg.norm(plain, axis=0))[0]

    def is_estimable(self, contrast) -> bool:
        c = np.asarray(contrast, float)
        if c.shape != self.norms.shape or not np.isfinite(c).all():
            raise SpecificationError(f"a contrast has a finite number for each of the {len(self.names)} columns")
        c = c / self.norms
        return bool((np.abs(self.directions.T @ c) <= TOLERANCE * np.linalg.norm(c)).all())

    def determined(self, columns: Sequence[Column]) -> Column:
        """is_estimable for the rows of a table: columns, one for each fixed column, are the contrast."""
        scaled = [c / F.lit(float(n)) for c, n in zip(columns, self.norms, strict=True)]
        total = lambda terms: reduce(lambda a, b: a + b, terms)
        ok = F.lit(True)
        if self.dropped:
            size = F.sqrt(total([c * c for c in scaled]))
            for d in self.directions.T:
                ok = ok & (F.abs(total([F.lit(float(x)) * c for x, c in zip(d, scaled, strict=True) if x])) <= ROW_TOLERANCE * size)
        return ok

    def table(self, spark: SparkSession) -> DataFrame:
        """(dropped, name, coefficient): a row for each dropped column and each kept one."""
        rows = [(self.names[d], self.names[k], float(self.aliases[i, j])) for j, d in enumerate(self.dropped) for i, k in enumerate(self.kept)]
        return spark.createDataFrame(rows, "dropped string, name string, coefficient double")


def of(r: np.ndarray, names: Sequence[str], kept: list[int] | None = None) -> Rank:
    """The rank of the columns whose R factor is r; kept, if known, are the columns of a fit."""
    r = np.asarray(r, float)
    if r.shape[1] != len(names) or not np.isfinite(r).all():
        raise SpecificationError("R must be finite and have a column for each name")
    kept = independent_columns(r, TOLERANCE) if kept is None else list(kept)
    dropped = [k for k in range(len(names)) if k not in set(kept)]
    norms = np.linalg.norm(r, axis=0)
    norms[norms == 0] = 1
    unit = r / norms
    aliases = np.linalg.lstsq(unit[:, kept], unit[:, dropped], rcond=None)[0]
    left = np.linalg.norm(unit[:, dropped] - unit[:, kept] @ aliases, axis=0)
    if (left > TOLERANCE * max(1.0, float(np.linalg.norm(unit, 2)) if unit.size else 1.0)).any():
        raise NumericalError("a dropped column is no combination of the kept ones")
    null = np.zeros((len(names), len(dropped)))
    null[dropped, np.arange(len(dropped))] = 1
    null[kept] = -aliases
    return Rank(tuple(names), kept, dropped, aliases * norms[dropped] / norms[kept][:, None], norms, np.linalg.qr(null)[0])
