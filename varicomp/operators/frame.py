"""The model frame: row selection, missing values, labels and design columns, all as Catalyst expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varicomp.errors import SpecificationError
from varicomp.plans.formula import Formula

MOST_LEVELS = 10_000


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def row_status(df: DataFrame, required: list[str], subset: str | None = None) -> Column:
    """excluded (the subset is false), else omitted (a required value is missing), else retained."""
    missing = reduce(lambda a, b: a | b, [is_missing(df, c) for c in required])
    chosen = F.coalesce(F.col(f"`{subset}`"), F.raise_error(F.lit("the subset is null in a row")).cast("boolean")) if subset else F.lit(True)
    return F.when(~chosen, "excluded").when(missing, "omitted").otherwise("retained")


def observed_levels(df: DataFrame, names: list[str], declared: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The levels that occur, in declared or else binary order; one job for all columns, which never fetches more than the
    limit of levels a column and one."""
    if not names:
        return {}
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").alias("level")) for k, c in enumerate(names)])
    found = df.select(F.inline(pairs)).where("level is not null").distinct()
    seen: list[set[str]] = [set() for _ in names]
    for k, level in found.limit(len(names) * (MOST_LEVELS + 1)).collect():
        seen[k].add(level)
    for c, levels in zip(names, seen, strict=True):  # where the limit of rows was reached, some column is over its own
        if len(levels) > MOST_LEVELS:
            raise SpecificationError(f"{c} has more than {MOST_LEVELS} levels; use it as a group")
    order = declared or {}
    return {c: [x for x in order[c] if x in levels] if order.get(c) else sorted(levels) for c, levels in zip(names, seen, strict=True)}


def group_label(parts: tuple[str, ...]) -> Column:
    """The label of nested or crossed groups; null if a part is null."""
    cols = [F.col(f"`{p}`") for p in parts]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(whole, F.concat_ws(":", *cols))


@dataclass(frozen=True)
class Encoder:
    """Fixed-effect columns, frozen at the fit and used again on new rows."""

    terms: tuple[tuple[str, ...], ...]
    levels: dict[str, list[str]] = field(default_factory=dict)
    coding: dict[str, str] = field(default_factory=dict)

    def variable(self, name: str) -> list[tuple[str, Column]]:
        """Its columns by name: itself, or K - 1 indicator (treatment) or deviation (sum) columns."""
        c = F.col(f"`{name}`")
        if name not in self.levels:
            return [(name, c.cast("double"))]
        levels = self.levels[name]
        if len(levels) < 2:
            raise SpecificationError(f"{name} has fewer than two levels")
        if self.coding.get(name, "treatment") == "treatment":
            return [(f"{name}{lv}", F.when(c == lv, 1.0).otherwise(0.0)) for lv in levels[1:]]
        return [(f"{name}{k + 1}", F.when(c == lv, 1.0).when(c == levels[-1], -1.0).otherwise(0.0)) for k, lv in enumerate(levels[:-1])]

    def columns(self) -> list[tuple[str, Column]]:
        out = [("(Intercept)", F.lit(1.0))]
        for term in self.terms:
            for combo in product(*(self.variable(v) for v in term)):
                out.append((":".join(n for n, _ in combo), reduce(lambda a, b: a * b, [c for _, c in combo])))
        return out

    def unknown(self) -> Column:
        """Whether a row has a level that the fit did not see; a null level is one."""
        tests = [~F.coalesce(F.col(f"`{v}`").isin(lv), F.lit(False)) for v, lv in self.levels.items() if any(v in t for t in self.terms)]
        return reduce(lambda a, b: a | b, tests, F.lit(False))


def check_rows(df: DataFrame, kept: DataFrame, required: list[str], formula: Formula, subset: str | None, na_action: str) -> None:
    """Refuses a null subset, missing values that are not to be omitted, and labels that stand for several groups; two jobs at most."""
    counts = [F.count_if(F.col(f"`{subset}`").isNull())] if subset else [F.lit(0)]
    if na_action == "error":
        chosen = F.col(f"`{subset}`") if subset else F.lit(True)
        counts += [F.count_if(chosen & is_missing(df, c)) for c in required]
    if subset or na_action == "error":
        found = df.agg(*[c.alias(f"n{k}") for k, c in enumerate(counts)]).first()
        if found[0]:
            raise SpecificationError(f"the subset {subset} is null in {found[0]} rows")
        if short := {c: n for c, n in zip(required, found[1:], strict=False) if n}:
            raise SpecificationError("required values are missing: " + ", ".join(f"{c} in {n} rows" for c, n in short.items()))
    several = [t.group for t in formula.random if len(t.group) > 1]
    if several:
        # a label joins its parts by a colon, so only parts with a colon can make two groups one label
        risky = reduce(lambda a, b: a | b, [F.col(f"`{p}`").contains(":") for g in several for p in g])
        if not kept.where(risky).limit(1).isEmpty():
            pairs = [c for g in several for c in (F.count_distinct(group_label(g)), F.count_distinct(*[F.col(f"`{p}`") for p in g]))]
            n = kept.agg(*pairs).first()
            for k, g in enumerate(several):
                if n[2 * k] != n[2 * k + 1]:
                    raise SpecificationError(f"labels of {':'.join(g)} are ambiguous, as parts contain a colon")


@dataclass(frozen=True)
class Frame:
    rows: DataFrame  # __y, __w, __o, __x0.., __id, __g0.., __z<term>_<k>
    status: DataFrame  # the input with __status
    encoder: Encoder
    random_encoder: Encoder
    random_names: tuple[tuple[str, ...], ...]
    formula: Formula


def build(df: DataFrame, formula: Formula, weights: str | None = None, offset: str | None = None, subset: str | None = None, na_action: str = "error", contrasts: dict | None = None, random_contrasts: dict | None = None, levels: dict | None = None, row_id: str | None = None) -> Frame:
    required = formula.variables + [c for c in (weights, offset) if c]
    for c in required + [c for c in (subset, row_id) if c]:
        if c not in df.columns:
            raise SpecificationError(f"there is no column {c}")
    kinds = {f.name: f.dataType for f in df.schema}
    for t in formula.random:
        for g in t.group:
            if not isinstance(kinds[g], T.StringType):
                raise SpecificationError(f"the group {g} must be a string column; cast it")
    if subset and not isinstance(kinds[subset], T.BooleanType):
        raise SpecificationError("the subset must be a boolean column")
    if na_action not in ("error", "omit"):
        raise SpecificationError("na_action is error or omit")
    marked = df.withColumn("__status", row_status(df, required, subset))
    kept = marked.where("__status = 'retained'")
    check_rows(df, kept, required, formula, subset, na_action)
    variables = [v for t in formula.fixed for v in t] + [t.slope for t in formula.random if t.slope]
    categorical = [v for v in dict.fromkeys(variables) if isinstance(kinds[v], T.StringType)]
    found = observed_levels(kept, categorical, levels)
    encoder = Encoder(formula.fixed, found, contrasts or {})
    random_encoder = Encoder(formula.fixed, found, random_contrasts or {})
    cols = [F.col(f"`{formula.response}`").cast("double").alias("__y"), (F.col(f"`{weights}`").cast("double") if weights else F.lit(1.0)).alias("__w")]
    offsets = [F.col(f"`{o}`").cast("double") for o in (*formula.offsets, *([offset] if offset else []))]
    cols.append(reduce(lambda a, b: a + b, offsets, F.lit(0.0)).alias("__o"))
    cols += [c.alias(f"__x{k}") for k, (_, c) in enumerate(encoder.columns())]
    if row_id:
        cols.append(F.col(f"`{row_id}`").alias("__id"))
    names = []
    for k, t in enumerate(formula.random):
        z = [("(Intercept)", F.lit(1.0))] + (random_encoder.variable(t.slope) if t.slope else [])
        if t.slope in found and not t.correlated:
            raise SpecificationError("independent terms of a categorical slope are not supported")
        names.append(tuple(n for n, _ in z))
        cols += [group_label(t.group).alias(f"__g{k}")] + [c.alias(f"__z{k}_{j}") for j, (_, c) in enumerate(z)]
    return Frame(kept.select(*cols), marked, encoder, random_encoder, tuple(names), formula)
