"""What each filter of a chain removes, in every order of the filters, from one CUBE over their failure flags.

Rows are counted once by (part, flags). CUBE over the flags and the part then has a row for each set of selected flags; the one
whose selected flags are all false counts what passes this set, in whatever order it is applied. A step of an order joins
two such sets: those before it, and with its own filter. So the 600 steps of five filters cost 80 pairs of sets a part.

Null texts count as empty, a null part as an empty string. A null id is neither smaller nor greater than another, so it's no
earlier copy, and has none. Rows that are repeated with their id are kept apart by none of the filters. An id with several
label rows counts as good or toxic if one of them says so. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain, combinations, permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LETTERS = "ABCDE"
_COUNTS = ["docs", "good", "toxic"]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, digest, A, B, C, D) of each row: the flags that its own text decides, and the text's SHA-256."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    return rows.select(
        "id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (n < 50).alias("A"),
        (100 * distinct.cast("long") < 65 * n.cast("long")).alias("B"),
        (100 * capitals > 5 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )


def flag_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A to E, docs, good, toxic): how many rows have these flags, and how many of them are labelled so.

    A text of many copies is no hot key: copies are counted where they are read, its smallest id comes from partial
    minima, and is joined by digest and id together.
    """
    label = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("label_id")).agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic")).withColumn("zero", F.lit(0).cast("long"))
    rows = failures(docs, id_col, text_col, part_col).groupBy("id", "part", "digest", "A", "B", "C", "D").agg(F.count("*").alias("docs"))
    rows = materialize(rows, "flags")
    first = rows.groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("low"))
    flagged = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("id") == F.col("low")), "left")
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0)  # rows without an id don't meet in one task
    flagged = flagged.withColumn("spread", spread).join(label, (F.col("id") == F.col("label_id")) & (F.col("spread") == F.col("zero")), "left")
    copy = F.col("low").isNull() & F.col("id").isNotNull()
    one = lambda c: F.sum(F.when(F.col(c), F.col("docs")).otherwise(0))
    return flagged.groupBy("part", "A", "B", "C", "D", copy.alias("E")).agg(F.sum("docs").alias("docs"), one("is_good").alias("good"), one("is_toxic").alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, passed, docs, good, toxic): what passes each set of filters, as a number with a bit for each; no row for nobody."""
    # CUBE's number has a bit for each column that is not selected, the first column highest
    cube = counts.cube("part", *LETTERS).agg(F.grouping_id().alias("left_out"), *[F.sum(c).alias(c) for c in _COUNTS])
    chosen = 2 ** len(LETTERS) - 1 - F.col("left_out")
    clear = F.col("left_out") < 2 ** len(LETTERS)  # the part is selected
    for x in LETTERS:
        clear &= F.coalesce(~F.col(x), F.lit(True))
    return cube.where(clear).select("part", chosen.cast("int").alias("passed"), *_COUNTS)


def _bit(letter: str) -> int:
    return 1 << (len(LETTERS) - 1 - LETTERS.index(letter))


def _set(letters) -> int:
    return sum(map(_bit, letters))


def interactions(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each
    part, order of the filters and step."""
    spark, n = counts.sparkSession, len(LETTERS)
    sets = materialize(survivors(counts), "survivors")
    pairs = []  # (filter, what was applied before, with it, in how many orders)
    for x in LETTERS:
        rest = [y for y in LETTERS if y != x]
        for before in chain.from_iterable(combinations(rest, k) for k in range(n)):
            pairs.append((x, _set(before), _set(before) | _bit(x), factorial(len(before)) * factorial(n - 1 - len(before))))
    plan = F.array(*[F.struct(F.lit(x).alias("filter"), F.lit(a).alias("before"), F.lit(b).alias("after"), F.lit(k).cast("long").alias("orders")) for x, a, b, k in pairs])
    steps = sets.where("passed = 0").select("part", F.inline(plan))
    side = lambda name: sets.select("part", F.col("passed").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in _COUNTS])
    met = steps.join(side("before"), ["part", "before"], "left").join(side("after"), ["part", "after"], "left").na.fill(0)
    lost = met.select("part", "filter", "before", "orders", F.col("after_docs").alias("kept"), *[(F.col(f"before_{c}") - F.col(f"after_{c}")).alias(c) for c in _COUNTS])
    of = lost.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("docs"))).alias("fails"),
        F.max(F.when(F.bit_count("before") == n - 1, F.col("docs"))).alias("unique_fails"),
        F.sum(F.col("docs") * F.col("orders")).alias("shapley"),
    )
    orders = [("".join(o), k + 1, o[k], _set(o[:k])) for o in permutations(LETTERS) for k in range(n)]
    order = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter string, before int"))
    return lost.join(of, ["part", "filter"]).join(order, ["filter", "before"]).select("part", "filter_order", "step", "kept", F.col("docs").alias("removed"), (F.col("fails") - F.col("docs")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    return interactions(flag_counts(docs, labels, **columns))
