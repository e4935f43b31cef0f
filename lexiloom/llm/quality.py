"""Quality scores by regularised quadratic discriminant analysis.

Each class is a Gaussian over transformed document statistics. Its covariance is
shrunk towards the pooled covariance and towards a multiple of the identity. A
score is the logistic of the log-density difference plus the log-odds of the
classes, from Mahalanobis distances by Cholesky factors that are made once.
Spark sums the moments, so that the model is fitted on every labelled row; how
much is shrunk is chosen by cross-validation over the folds that labels may be
learnt from, by the least log loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import FLAGS, bounded_batches, cut, flags, whole_text

#: Shares of the pooled covariance, and of the identity, in each class's own, to choose from.
SHRINKAGE = tuple((pooled, identity) for pooled in (0.05, 0.2, 0.5, 0.9) for identity in (0.001, 0.01, 0.05, 0.2))
THRESHOLD = 0.3
FOLDS = 5

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_STOPS = np.isin(_BYTE, list(b".,;:?'\"()-"))
_SPACE = np.isin(_BYTE, list(b" \t\n\r\x0b\x0c"))
_SYMBOL = (_BYTE < 128) & ~(_UPPER | _LOWER | _DIGIT | _STOPS | _SPACE)
_CLASSES = np.stack([_UPPER, _UPPER | _LOWER, _DIGIT, _STOPS, _SYMBOL, ~_SPACE]).astype(np.float64)
N_FEATURES = 9


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text.

    Logarithms of counts and lengths, square roots of shares: words, upper case,
    digits, stops, symbols, vocabulary growth (log distinct words by log words),
    word length, distinct lines, and words that end a repeated pair.
    """
    counts = _CLASSES @ np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, letters, digits, stops, symbols, solid = counts.tolist()
    words = text.split()
    n = len(words)
    lines = text.split("\n")
    pairs = set(zip(words, words[1:], strict=False))
    solid = max(solid, 1.0)
    return [
        float(np.log1p(n)),
        (upper / max(letters, 1.0)) ** 0.5,
        (digits / solid) ** 0.5,
        (stops / solid) ** 0.5,
        (symbols / solid) ** 0.5,
        float(np.log(len(set(words))) / np.log(n)) if n > 1 else 1.0,
        float(np.log1p(len(text) / max(n, 1))),
        (len(set(lines)) / len(lines)) ** 0.5,
        ((n - 1 - len(pairs)) / (n - 1)) ** 0.5 if n > 1 else 0.0,
    ]


def features(text: Column) -> Column:
    """``statistics`` of a text column as an array; null counts as empty."""
    return pandas_udf(lambda s: pd.Series([statistics(x) for x in s]), "array<double>")(F.coalesce(text, F.lit("")))


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    """0 (held out) to ``folds`` - 1; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """True for the rows that labels are never learnt from."""
    return F.coalesce(fold_of(doc_id, folds) == 0, F.lit(False))


@dataclass
class Model:
    """``prior``: log-odds of class 1. ``classes``: mean, inverse Cholesky factor and log-determinant of each class; None if a class had no rows."""

    prior: float
    classes: list[tuple[np.ndarray, np.ndarray, float]] | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        if self.classes is not None:
            for sign, (mean, whiten, logdet) in zip((-1, 1), self.classes, strict=True):
                z -= sign * 0.5 * (np.square((x - mean) @ whiten.T).sum(axis=1) + logdet)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums = np.zeros((FOLDS, 2, 1 + N_FEATURES, 1 + N_FEATURES))
    for pdf in batches:
        if len(pdf):
            x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_list())])
            fold, label = pdf["fold"].to_numpy(), pdf["label"].to_numpy()
            for f, k in np.ndindex(FOLDS, 2):
                own = x[(fold == f) & (label == k)]
                sums[f, k] += own.T @ own
    at = np.indices(sums.shape).reshape(4, -1)
    yield pd.DataFrame({"fold": at[0], "label": at[1], "i": at[2], "j": at[3], "v": sums.ravel()})


def model_of(sums: np.ndarray, pooled: float, identity: float) -> Model:
    """The model by the moments of both classes (of 1 and x, by 1 and x)."""
    n = sums[:, 0, 0]
    if not n.all():
        return Model(0.0 if not n.any() else 700.0 if n[1] else -700.0, None)
    means = sums[:, 0, 1:] / n[:, None]
    scatter = sums[:, 1:, 1:] - n[:, None, None] * np.einsum("ki,kj->kij", means, means)
    common = scatter.sum(axis=0) / n.sum()
    classes = []
    for k in (0, 1):
        own = (1 - pooled) * scatter[k] / n[k] + pooled * common
        own = (1 - identity) * own + (identity * np.trace(own) / N_FEATURES + 1e-6) * np.eye(N_FEATURES)
        factor = np.linalg.cholesky((own + own.T) / 2)
        classes.append((means[k], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return Model(float(np.log(n[1] / n[0])), classes)


def _losses(batches: Iterator[pd.DataFrame], models: dict[int, list[Model]]) -> Iterator[pd.DataFrame]:
    """Summed log loss of each choice of shrinkage, each row by the models of the other folds."""
    sums = np.zeros(len(SHRINKAGE))
    for pdf in batches:
        fold, label = pdf["fold"].to_numpy(), pdf["label"].to_numpy()
        for f in np.unique(fold).tolist():
            own = fold == f
            x, y = np.stack(pdf["x"][own].to_list()), label[own]
            for c, model in enumerate(models[f]):
                p = np.clip(model.scores(x), 1e-12, 1 - 1e-12)
                sums[c] -= np.log(np.where(y == 1, p, 1 - p)).sum()
    yield pd.DataFrame({"choice": np.arange(len(SHRINKAGE)), "loss": sums})


def fit(examples: DataFrame) -> Model:
    """``examples(x array, label 0/1, fold)`` -> model; only moments and losses reach the driver."""
    rows = cut(examples.where("label in (0, 1)").select("x", F.col("label").cast("int").alias("label"), F.coalesce(F.col("fold").cast("int"), F.lit(1)).alias("fold")))
    sums = np.zeros((FOLDS, 2, 1 + N_FEATURES, 1 + N_FEATURES))
    for r in rows.mapInPandas(_moments, "fold int, label int, i int, j int, v double").groupBy("fold", "label", "i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r["fold"], r["label"], r["i"], r["j"]] = r["v"]
    total = sums.sum(axis=0)
    models = {f: [model_of(total - sums[f], *choice) for choice in SHRINKAGE] for f in range(FOLDS)}
    lost = rows.mapInPandas(lambda it: _losses(it, models), "choice int, loss double").groupBy("choice").agg(F.sum("loss").alias("loss")).collect()
    best = min(lost, key=lambda r: (round(r["loss"], 6), r["choice"]))["choice"] if lost else 0
    return model_of(total, *SHRINKAGE[best])


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows outside the held-out fold with their label and fold."""
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").alias("label"))
    return rows.where(~held_out(F.col("doc_id"))).join(known, "doc_id").withColumn("fold", fold_of(F.col("doc_id")))


def train(measured: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``measured(doc_id, x)`` and ``labels(doc_id, quality)`` outside the held-out fold."""
    return fit(_labelled(measured, labels))


def _scored(measured: DataFrame, model: Model) -> DataFrame:
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def score(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.stack(x.to_list())) if len(x) else [], dtype="float64")

    out = measured.withColumn("score", pandas_udf(score, "double")("x"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every row of ``docs(doc_id, text, ...)``.

    Returns doc_id, held_out, score (0 to 1, higher: label 1 likelier) and
    predicted (1 if score >= 0.3). Null text counts as empty; a null doc_id is
    never held out and never labelled; repeated rows each get a row, and repeated
    labels each count; labels other than 0 and 1 are ignored. With one class
    only, all scores are that class (0 or 1); with no labels they are 0.5. An
    empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    measured = cut(docs.select("doc_id", features(F.col("text")).alias("x")))
    return _scored(measured, train(measured, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, with all their columns.

    For the fit only rows that can have a label (by a hash table of bounded size)
    are measured, before they meet their labels, so no text is shuffled; every row
    is then measured where it is judged.

    Null and empty texts are judged by the statistics of a text without words; a
    null doc_id has no label, and its row is judged like any other; repeated rows
    are judged alike and all stay or all go; an empty table stays empty; other
    columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    ident = F.xxhash64(F.col("doc_id").cast("string"))
    wanted = docs.sparkSession.sparkContext.broadcast(flags(labels.where("quality in (0, 1)").select("doc_id"), ident))

    def measured_if(text: pd.Series, bucket: pd.Series) -> pd.Series:
        return pd.Series([statistics(x) if wanted.value[b] else None for x, b in zip(text, bucket, strict=True)], dtype="object")

    x = pandas_udf(measured_if, "array<double>")(whole_text(), F.pmod(ident, F.lit(FLAGS)).cast("int"))
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", x.alias("x")).where("x is not null"), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    good = pandas_udf(lambda s: pd.Series(shared.value.scores(np.array([statistics(x) for x in s]).reshape(-1, N_FEATURES)) >= THRESHOLD), "boolean")
    return docs.where(good(whole_text()))
