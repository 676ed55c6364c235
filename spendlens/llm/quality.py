"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics. Per class, counts, sums and products
are added up by Spark over all training rows; the driver turns them into means and
shrunk covariances, whose Cholesky factors are inverted once. A score is the logistic of
the difference of the two Gaussian log-densities plus the log prior ratio.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.arrow import flat, pieces

#: Byte classes that are counted, in this order; other bytes are class 0.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\x0b\x0c\r",
    "newline": b"\n",
    "stop": b".,;:",
    "shout": b"!?",
    "bar": b"|",
    "mark": b"#$%&*",
    "bracket": b"<>{}[]()/\\=+~^_@\"'`-",
    "high": bytes(range(0xC0, 0x100)),
}
FEATURES = [
    "log_bytes", *[f"share_{c}" for c in CLASSES], "word_length", "distinct_words",
    "distinct_lines", "line_words", "top_word",
]
#: Weight of the pooled covariance in each class's, and of the diagonal in the pooled one.
POOLED, DIAGONAL = 0.15, 0.15

_LOOKUP = np.zeros(256, np.int64)
for _number, _bytes in enumerate(CLASSES.values(), 1):
    _LOOKUP[list(_bytes)] = _number


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; an empty text has zero counts throughout."""
    data, bounds = flat(column)
    n, width = len(column), len(CLASSES) + 1
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(n) * width, sizes)
    counts = np.bincount(row + _LOOKUP[data], minlength=n * width).reshape(n, width)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.log1p(sizes)
    out[:, 1 : width] = np.log((counts[:, 1:] + 0.5) / (sizes[:, None] + 20.0))
    raw = data.tobytes()
    for i in range(n):
        text = raw[bounds[i] : bounds[i + 1]]
        words = text.split()
        lines = text.split(b"\n")
        kinds: dict[bytes, int] = {}
        for word in words:
            kinds[word] = kinds.get(word, 0) + 1
        k = len(words)
        out[i, width:] = (
            np.log((sum(map(len, words)) + 5.0) / (k + 1.0)),
            np.log((len(kinds) + 1.0) / (k + 1.0)),
            np.log((len(set(lines)) + 1.0) / (len(lines) + 1.0)),
            np.log((k + 1.0) / (len(lines) + 1.0)),
            np.log((max(kinds.values(), default=0) + 1.0) / (k + 2.0)),
        )
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row of (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = statistics(batch.column("text"))
            rows = pa.ListArray.from_arrays(
                np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1))
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per class 0 and 1: the sum over its rows of [1, x] outer [1, x]."""
    width = len(FEATURES) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("x"))
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[label == c]
                total[c] += own.T @ own
        yield pa.RecordBatch.from_pydict(
            {
                "class": np.repeat(np.arange(2, dtype=np.int32), width * width),
                "cell": np.tile(np.arange(width * width, dtype=np.int32), 2),
                "value": total.reshape(-1),
            }
        )

    cells = rows.mapInArrow(run, "class int, cell int, value double")
    out = {c: np.zeros(width * width) for c in (0, 1)}
    for c, cell, value in cells.groupBy("class", "cell").agg(F.sum("value")).collect():
        out[c][cell] = value
    return {c: m.reshape(width, width) for c, m in out.items()}


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray  # 2 x d
    inverses: np.ndarray  # 2 x d x d, inverse Cholesky factors
    offsets: np.ndarray  # 2: log prior - half the log determinant
    constant: float | None = None  # a class is missing: this score for all

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [
            self.offsets[c] - 0.5 * np.square((x - self.means[c]) @ self.inverses[c].T).sum(axis=1)
            for c in (0, 1)
        ]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(rows: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """The discriminant of (x, label) rows.

    With fewer than two rows of a class every score is (n1 + 1) / (n + 2).
    """
    sums = moments(rows)
    n = np.array([sums[c][0, 0] for c in (0, 1)])
    d = len(FEATURES)
    if n.min() < 2:
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), (n[1] + 1) / (n.sum() + 2))
    means = np.array([sums[c][0, 1:] / n[c] for c in (0, 1)])
    own = np.array([sums[c][1:, 1:] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    common = (n[:, None, None] * own).sum(axis=0) / n.sum()
    common = (1 - diagonal) * common + diagonal * np.diag(np.diag(common)) + 1e-6 * np.eye(d)
    factors = np.linalg.cholesky((1 - pooled) * own + pooled * common)
    half_logs = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(means, np.linalg.inv(factors), np.log(n / n.sum()) - half_logs)


def predict(rows: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score, predicted) of (doc_id, x) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = model.score(_vectors(batch.column("x")))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "score": score,
                    "predicted": (score >= 0.5).astype(np.int32),
                }
            )

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def score_quality(docs: DataFrame, training_labels: DataFrame) -> DataFrame:
    """(doc_id, score, predicted): how likely each whole text is of good quality.

    ``docs`` has (doc_id, text), ``training_labels`` (doc_id, label 0 or 1) of the rows to
    learn from; a null label or id teaches nothing, a repeated label counts each time.
    Every row of ``docs`` gets a row; a null or empty text is scored like any other.
    The statistics are taken once and checkpointed, then read for learning and scoring.
    """
    x = features(docs).checkpoint()
    labels = training_labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    return predict(x, fit(x.join(labels, "doc_id").select("x", "label")))
