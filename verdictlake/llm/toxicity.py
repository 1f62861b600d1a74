"""Toxicity by a classifier chain: linear models in sequence, later ones fed with earlier categories' probabilities.

The chain is fitted in the driver on a bounded sample of labelled rows (SAMPLE); choosing its words and scoring run
on Spark. While fitting, a later model sees out-of-fold predictions of the earlier ones, so it learns from
probabilities as good as those that it gets for unseen documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake.llm.common import give_back, stable

#: Categories in chain order, as expressions over the labels table.
CATEGORIES = {"low_quality": "CAST(quality = 0 AS INT)", "toxic": "CAST(toxic = 1 AS INT)"}
#: Most labelled rows that the chain is fitted on, words for each category, documents that a word is in at least, and its least chi-squared.
SAMPLE, WORDS, LEAST, LEAST_CHI = 8000, 256, 5, 20.0
FOLDS, RIDGE, SPARSE, STEPS, THRESHOLD = 5, 2e-5, 1e-3, (150, 800), 0.5
LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of longer words that count as features too.
STEMS = (4, 5, 6)
SHAPE = ("symbols", "repeats", "length")


def words_of(text: str) -> set[str]:
    """A text's words in lower case, and the beginnings of longer ones, marked by a hyphen."""
    words = set(LETTERS.findall(text.lower()))
    return words.union(*({w[:k] + "-" for w in words if len(w) > k} for k in STEMS))


def shape_of(text: str, words: set[str]) -> tuple[float, float, float]:
    """Share of characters that are no letter, digit or space; share of words that repeat; size of the text. Each 0 to 1."""
    n = len(text)
    tokens = text.split()
    symbols = sum(map(text.count, "*#$%&@{}[]<>|\\^~=_+")) / n if n else 0.0
    return min(1.0, 4 * symbols), (1.0 - len(set(tokens)) / len(tokens)) if tokens else 0.0, min(1.0, np.log1p(n) / 12.0)


@dataclass
class Linear:
    """A logistic model; with one class only, its share."""

    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _descend(x: np.ndarray, y: np.ndarray, sparse: float, steps: int) -> np.ndarray:
    """Weights, the bias last: least mean log loss plus RIDGE / 2 times squared and `sparse` times absolute weights."""
    n, d = x.shape
    xb = np.hstack((x, np.ones((n, 1)))).astype(np.float32)
    y = y.astype(np.float32)
    ridge, shrink = np.full(d + 1, RIDGE, np.float32), np.full(d + 1, sparse, np.float32)
    ridge[-1] = shrink[-1] = 0.0
    v = np.ones(d + 1, np.float32)
    for _ in range(12):
        v = xb.T @ (xb @ v)
        v /= np.linalg.norm(v)
    rate = 1.0 / (0.25 * np.linalg.norm(xb @ v) ** 2 / n * 1.05 + RIDGE)
    w = z = np.zeros(d + 1, np.float32)
    t, rate = 1.0, np.float32(rate)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(xb @ z, -30, 30)))
        new = z - rate * (xb.T @ (p - y) / n + ridge * z)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * shrink, 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


def fit_linear(x: np.ndarray, y: np.ndarray) -> Linear:
    """A sparse fit chooses the features, a second one without that penalty sets their weights."""
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        return Linear(np.zeros(d), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    chosen = np.flatnonzero(_descend(x, y, SPARSE, STEPS[0])[:-1])
    fitted = _descend(x[:, chosen], y, 0.0, STEPS[1])
    weights = np.zeros(d)
    weights[chosen] = fitted[:-1]
    return Linear(weights, float(fitted[-1]))


@dataclass
class Chain:
    names: list[str]
    vocabulary: dict[str, int]
    models: list[Linear]

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.vocabulary) + len(SHAPE)))
        for i, text in enumerate(texts):
            words = words_of(text)
            for w in words & self.vocabulary.keys():
                out[i, self.vocabulary[w]] = 1.0
            out[i, len(self.vocabulary) :] = shape_of(text, words)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the categories, a column each, from features."""
        for model in self.models:
            x = np.hstack((x, model(x)[:, None]))
        return x[:, x.shape[1] - len(self.models) :]


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray, own: list[list[int]]) -> list[Linear]:
    """x: features; y: a column of labels for each category, in chain order; folds: the fold of each row.

    own: the features of each category's model; it sees all earlier categories' probabilities besides.
    """
    models: list[Linear] = []
    first = x.shape[1]
    for c in range(y.shape[1]):
        columns = [*own[c], *range(first, x.shape[1])]

        def fit(rows: np.ndarray, c: int = c, columns: list[int] = columns, x: np.ndarray = x) -> Linear:
            model = fit_linear(x[rows][:, columns], y[rows, c])
            weights = np.zeros(x.shape[1])
            weights[columns] = model.weights
            return Linear(weights, model.bias)

        models.append(fit(np.ones(len(x), dtype=bool)))
        if c + 1 < y.shape[1]:
            out = np.zeros(len(x))
            for f in range(FOLDS):
                held = folds == f
                if held.any():
                    out[held] = fit(~held)(x[held])
            x = np.hstack((x, out[:, None]))
    return models


def matrix(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of `width` floats as a matrix, without a Python object for each."""
    parts = [x.flatten().to_numpy() for x in rows.chunks]
    return np.concatenate(parts or [np.empty(0, np.float32)]).reshape(-1, width)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """Fits the chain on the `sample` labelled documents whose ids have the smallest hashes.

    Rows with a null id, text or label, and all but one row of a repeated id, take no part. Without labelled
    documents every probability is near 0.
    """
    names = list(categories)
    label = labels.select("doc_id", *[F.expr(e).alias(f"y{i}") for i, e in enumerate(categories.values())]).dropna()
    label = label.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    chosen = label.withColumn("h", F.xxhash64("doc_id", F.lit(11))).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # chosen: `sample` rows at most

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string()))], names=[*batch.schema.names, "words"])
        give_back()

    rows = stable(rows.mapInArrow(split, T.StructType([*rows.schema.fields, T.StructField("words", T.ArrayType(T.StringType()))])), "toxic-sample")
    total = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"y{i}"), F.lit(0)).alias(f"y{i}") for i in range(len(names))]).first()
    counts = stable(rows.select(F.explode("words").alias("w"), *[f"y{i}" for i in range(len(names))]).groupBy("w").agg(F.count("*").alias("n"), *[F.sum(f"y{i}").alias(f"y{i}") for i in range(len(names))]).where(F.col("n") >= LEAST), "toxic-words")
    # Of a word and its beginnings that the sample can't tell apart, one counts: the word, or else the longest.
    same = [F.left(F.col("w"), F.lit(4)).alias("_4"), "n", *[f"y{i}" for i in range(len(names))]]
    counts = stable(counts.groupBy(*same).agg(F.max(F.struct((~F.endswith(F.col("w"), F.lit("-"))).alias("whole"), F.length("w").alias("size"), "w")).getField("w").alias("w")), "toxic-features")
    words: dict[str, int] = {}
    own: list[list[int]] = [[] for _ in names]
    for i in range(len(names)):
        # chi-squared of a word and a category
        n, a, b, y = float(total["n"]), F.col(f"y{i}"), F.col("n") - F.col(f"y{i}"), float(total[f"y{i}"])
        chi = F.pow(a * (n - y) - b * y, F.lit(2.0)) * n / (F.col("n") * (n - F.col("n")) * y * (n - y)) if 0 < y < n else F.lit(0.0)
        for row in counts.withColumn("chi", F.when(F.col("n") < n, chi).otherwise(0.0)).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "w").limit(WORDS).collect():
            own[i].append(words.setdefault(row["w"], len(words)))
    chain = Chain(names, words, [])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(chain.features(batch.column("text").to_pylist()).astype(np.float32)), pa.list_(pa.float32())), *[batch.column(f"y{i}") for i in range(len(names))]], names=["doc_id", "x", *[f"y{i}" for i in range(len(names))]])

    table = rows.select("doc_id", "text", *[f"y{i}" for i in range(len(names))]).mapInArrow(featured, "doc_id long, x array<float>, " + ", ".join(f"y{i} int" for i in range(len(names)))).toArrow().sort_by("doc_id")
    d = len(words) + len(SHAPE)
    x = matrix(table.column("x"), d)
    y = np.stack([table.column(f"y{i}").to_numpy().astype(float) for i in range(len(names))], axis=1).reshape(-1, len(names))
    del table
    folds = np.random.default_rng(5).integers(0, FOLDS, len(x))
    chain.models = fit_chain(x, y, folds, [[*columns, *range(len(words), d)] for columns in own])
    return chain


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """Adds p_<category> and <category> (1 where the probability reaches the threshold, else 0) to every row of docs.

    Whole texts are read; null text counts as empty; repeated rows and null ids are scored like others. Columns of
    docs pass through; those of the same names as added ones are overwritten.
    """
    names = chain.names
    added = [f"p_{c}" for c in names]
    kept = [c for c in docs.columns if c not in (*added, *names)]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts = [chain(chain.features(texts[i : i + 1000])) for i in range(0, len(texts), 1000)] or [np.empty((0, len(names)))]
            p = np.vstack(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, i]) for i in range(len(names))]], names=[*batch.schema.names, *added])
        give_back()

    schema = docs.select(*kept).schema
    for c in added:
        schema = schema.add(c, "double")
    return docs.select(*kept).mapInArrow(run, schema).select("*", *[(F.col(f"p_{c}") >= threshold).cast("int").alias(c) for c in names])


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the chain calls toxic."""
    return score(docs, train(docs, labels)).where("toxic = 0").select(*docs.columns)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", "p_low_quality", "p_toxic", "low_quality", "toxic")
