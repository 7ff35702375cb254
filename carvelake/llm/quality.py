"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One scan turns each whole text into ``FEATURES`` (shares of byte classes, repetition, word and line shapes), each
through a logarithm so that its distribution is closer to a normal one. Per class, the number of labelled rows, the sum
of features and the sum of their products are partial aggregates over all labelled rows that may be learnt from; only
those few numbers reach the driver. Class covariances shrink towards the pooled diagonal. A score is the logistic of
the difference of the two log densities (Mahalanobis distances by cached Cholesky factors, log determinants) and of the
log class shares; it depends on the text alone.

Defined cases: a null text is an empty one, and is scored like any other; labels that are null or other than 0 and 1 are
ignored; each labelled row counts, repeated or contradicting ones too; without rows of both classes every score is
0.5; a null doc_id is not held out; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, place_of, saved_map, table

FEATURES = ["size", "lower", "upper", "digit", "stop", "mark", "shout", "space", "high", "word_length", "kinds", "repeated_lines", "line_length", "echoes"]
SHRINK = 0.15
#: A class covariance never has a standard deviation below this in any direction.
LEAST_STD = 0.05
_CLASSES = np.full(256, 5, np.uint8)  # 5: other marks
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"-()", b"\t\n\x0b\x0c\r ")):
    _CLASSES[list(_bytes)] = (0, 1, 2, 3, 7)[_k]
_CLASSES[ord("!")] = 4
_CLASSES[128:] = 6
#: Usual shares of the byte classes in prose, which count as ``USUAL`` further bytes so that a few words don't look odd.
USUAL = 40
_PRIOR = np.array([0.78, 0.02, 0.005, 0.02, 0.001, 0.002, 0.022, 0.15]) * USUAL


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    n = len(data)
    counts = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=8) if n else np.zeros(8)
    share = [math.log(c / (n + USUAL) + 0.01) for c in (counts + _PRIOR).tolist()]
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    return [
        math.log1p(n), share[0], share[1], share[2], share[3], share[5], share[4], share[7], share[6],
        math.log((n + 6 * USUAL) / (len(words) + USUAL)),
        math.log((len(set(words)) + 1) / (len(words) + 1)),
        math.log((len(lines) + 1 - len(set(lines))) / (len(lines) + 1) + 0.05),
        math.log((n + 2 * USUAL) / (len(lines) + 1)),
        math.log(sum(map(eq, words, islice(words, 1, None))) / (len(words) + USUAL / 8) + 0.02),
    ]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def document_features(docs: DataFrame) -> DataFrame:
    """Saved: doc_id and x, the features of the text, of every row of ``docs``."""
    return saved_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _feature_rows, "doc_id long, x array<double>", "quality-features")


@dataclass(frozen=True)
class Model:
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]  # inverses of the Cholesky factors
    offset: float  # log class shares and half log determinants

    def scores(self, x: np.ndarray) -> np.ndarray:
        far = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors)]
        return 1 / (1 + np.exp(-np.clip(self.offset + (far[0] - far[1]) / 2, -500, 500)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = np.array(batch.column(0).to_pylist())
        x = batch.column(1).values.to_numpy().reshape(-1, d) if batch.num_rows else np.zeros((0, d))
        for c in (0, 1):
            own = x[y == c] if len(y) else x
            total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([0, 1], total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), 2)), pa.array(total.ravel())], ["y", "place", "value"]
    )


def fit(labelled: DataFrame, shrink: float = SHRINK) -> Model | None:
    """A model from rows (y int, x array<double>)."""
    d = len(FEATURES)
    found = labelled.where("y in (0, 1)").select("y", "x").mapInArrow(_moments, "y long, place long, value double").groupBy("y", "place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in found:
        total[r.y, r.place] = r.value
    n = total[:, 0]
    if (n < 2).any():
        return None
    means = [total[c, 1 : 1 + d] / n[c] for c in (0, 1)]
    spread = [total[c, 1 + d :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag(np.diag((spread[0] * n[0] + spread[1] * n[1]) / n.sum()))
    factors, half = [], []
    for s in spread:
        cov = (1 - shrink) * s + shrink * pooled + LEAST_STD**2 * np.eye(d)
        chol = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(chol))
        half.append(np.log(np.diag(chol)).sum())
    return Model(tuple(means), tuple(factors), float(np.log(n[1] / n[0]) + half[0] - half[1]))


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``rows`` but x, and score."""
    kept = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).to_pylist(), float).reshape(-1, len(FEATURES))
            score = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*kept, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "x")
    return rows.select(*kept, "x").mapInArrow(run, f"{kinds}, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(rows: DataFrame, labels: DataFrame) -> Model | None:
    """A model from feature rows (doc_id, x) and the labels of those that are not held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(~held_out() & F.col("y").isin(0, 1))
    return fit(rows.select("doc_id", "x").join(usable, "doc_id"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score of every row of ``docs`` (doc_id, text)."""
    rows = document_features(docs)
    return scored(rows, learn(rows, labels))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, with all their columns."""
    model = learn(document_features(docs), labels)
    at = place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= least if model else np.ones(len(x), bool)))

    rows = numbered(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
