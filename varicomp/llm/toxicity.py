"""Toxicity by a classifier chain.

The categories are predicted in turn: the model of each is a logistic regression on the words of the document and the
probabilities of the categories before it. For training those are out-of-fold predictions, so that a later model sees
them as good as they will be on new documents.

Training takes at most SAMPLE labelled documents of each value of the last category (those with the smallest hash of id
and text; of equal texts one), and as features the FEATURES words of at least LEAST of them that tell the categories
best, by chi-squared. Everything else covers all rows. Ids with a null label, or with rows that disagree, are not learned from; if a category lacks positives
or negatives its probability is constant. Null and empty texts have no words and get the intercepts' probabilities.
Repeated rows and null ids are scored like any other row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, small_batches, utf8_views

SAMPLE = 3000
FEATURES = 512
LEAST = 8
FOLDS = 5
_STRIP = ".,;:!?\"'()[]{}<>*#%&$|-_=+/\\~`^@"
_WORD_SQL = "array_distinct(transform(split(lower(text), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> trim(BOTH '.,;:!?\"\\'()[]{}<>*#%&$|-_=+/\\\\~`^@' FROM w)))"


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the intercept last, by Newton's method; only the other weights are penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, penalty: float = 1.0) -> list[np.ndarray]:
    """A weight vector for each column of labels; the k-th has k weights, of the earlier categories' logits, before the intercept."""
    chain, earlier = [], np.zeros((len(x), 0))
    for k in range(labels.shape[1]):
        y, xs = labels[:, k].astype(float), np.column_stack([x, earlier])
        if not len(y) or y.min() == y.max():
            chain.append(np.r_[np.zeros(xs.shape[1]), 8.0 if len(y) and y[0] else -8.0])
            earlier = np.column_stack([earlier, np.zeros(len(x))])
            continue
        chain.append(fit_logistic(xs, y, penalty))
        out = np.zeros(len(x))
        for f in np.unique(fold):
            held = fold == f
            part = fit_logistic(xs[~held], y[~held], penalty) if y[~held].min() < y[~held].max() else chain[-1]
            out[held] = _probability(xs[held], part)
        earlier = np.column_stack([earlier, out])
    return chain


class Chain:
    def __init__(self, words: list[str], weights: list[np.ndarray], categories: list[str]):
        self.words, self.weights, self.categories = words, weights, categories

    def score(self, documents: list[list[int]]) -> np.ndarray:
        """Probabilities from each document's numbers of known words."""
        n, out = len(self.words), np.zeros((len(documents), 0))
        row = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        word = np.array([w for d in documents for w in d], np.int64)
        for w in self.weights:
            z = np.bincount(row, w[word], len(documents)) + out @ w[n:-1] + w[-1]
            out = np.column_stack([out, 1 / (1 + np.exp(-np.clip(z, -30, 30)))])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, features: int = FEATURES) -> Chain:
    ys = [f"y{k}" for k in range(len(categories))]
    known = labels.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").cast("int").alias(y) for c, y in zip(categories, ys, strict=True)]).where("id is not null")
    one = F.lit(True)
    for y in ys:
        one = one & (F.count(y) == F.count("*")) & (F.min(y) == F.max(y))
    known = known.groupBy("id").agg(*[F.max(y).alias(y) for y in ys], one.alias("one")).where("one").drop("one")
    last = f"y{len(categories) - 1}"
    order = F.xxhash64("id")
    # the ids with the smallest hashes, some more than needed as equal texts count once
    few = known.where(F.col(last) == 1).orderBy(order, "id").limit(2 * sample).union(known.where(F.col(last) == 0).orderBy(order, "id").limit(2 * sample))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(few), "id")  # at most 4 * sample rows of a few numbers
    # only words leave the texts; of equal texts the one with the smallest id stays
    words = chosen.select("id", *ys, F.xxhash64("text").alias("same"), F.expr(_WORD_SQL).alias("words"))
    words = words.withColumn("copy", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where("copy = 1").withColumn("place", F.row_number().over(Window.partitionBy(last).orderBy(order, "id"))).where(F.col("place") <= sample)
    words = words.select("id", *ys, "words").persist()
    try:
        total = words.agg(F.count("*"), *[F.sum(y) for y in ys]).first()
        n = total[0]
        counts = words.select(F.explode("words").alias("word"), *ys).where("word != ''").groupBy("word").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).where(F.col("n") >= LEAST)
        chi = F.lit(0.0)
        for y, pos in zip(ys, total[1:], strict=True):
            if pos and pos < n:
                share = pos / n
                chi = F.greatest(chi, (F.col(y) - F.col("n") * share) ** 2 / (F.col("n") * share * (1 - share)))
        best = [r[0] for r in counts.select("word", chi.alias("chi")).orderBy(F.desc("chi"), "word").limit(features).collect()]
        rows = words.select("id", *ys, F.array_intersect("words", F.array(*[F.lit(w) for w in best])).alias("w") if best else F.array().cast("array<string>").alias("w")).collect()
    finally:
        words.unpersist()
    rows.sort(key=lambda r: r[0])
    number = {w: k for k, w in enumerate(best)}
    x = np.zeros((len(rows), len(best)))
    for k, r in enumerate(rows):
        x[k, [number[w] for w in r[-1]]] = 1
    y = np.array([r[1:-1] for r in rows]).reshape(len(rows), len(categories))
    return Chain(best, fit_chain(x, y, np.arange(len(rows)) % FOLDS), categories)


def _score(chain: Chain):
    """From columns and, last, the text in lower case: the columns and the probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w.encode(): k for k, w in enumerate(chain.words)}
        strip = _STRIP.encode()
        for batch in batches:
            data, offsets = utf8_views(batch.column(batch.num_columns - 1))
            data, at, seen = data.tobytes(), offsets.tolist(), {}
            hits = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                hit = set()
                for w in set(data[a:b].split()):
                    if w in number:
                        hit.add(number[w])
                    elif not (w[-1:].isalnum() and w[:1].isalnum()) and (s := w.strip(strip)) in number:
                        hit.add(number[s])
                hits.append(sorted(hit))
            p = chain.score(hits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=[*batch.schema.names[:-1], *(f"__p_{c}" for c in chain.categories)])

    return run


def with_probabilities(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs (its text column last) and __p_<category> (double) of each category."""
    small_batches(docs.sparkSession)
    last = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(f"`{text_col}`").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in last.schema)
    lowered = last.withColumn("__lower", F.lower(F.col(f"`{text_col}`")))  # by the function that training uses
    return map_arrow(lowered, _score(chain), schema + "".join(f", `__p_{c}` double" for c in chain.categories))


def clean_documents(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose last category is less likely than threshold; all columns in their order."""
    scored = with_probabilities(docs, chain, text_col)
    return scored.where(F.col(f"__p_{chain.categories[-1]}") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
