"""Linear models by products with the rows only: no k x k matrix is ever formed.

A model of k features, most of them entries of a sparse vector, is fitted by conjugate gradients (ordinary, ridge) or
accelerated proximal steps (lasso). Each step sends k numbers to the tasks and adds up k
numbers per task, in two levels, so memory is a few vectors of k on the driver and in a task. From a start
at zero conjugate gradients reach the shortest least-squares solution, as ``regression.fit`` does.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions import sql_text as sql
from spendlens.operators.checks import require_columns
from spendlens.operators.regression import DEFAULT_ALPHA

log = logging.getLogger(__name__)

#: Coefficients that a model may have: a task and the driver hold some vectors of that many numbers.
MAX_COEFFICIENTS = 10_000_000
#: Tasks of the second level of a sum: the driver adds up so many vectors.
ADDERS = 8
#: Relative size of the residual (or of a lasso's step) at which a fit is done, and the most steps.
TOLERANCE, MAX_STEPS = 1e-11, 1000


@dataclass(frozen=True)
class SparseModel:
    """Coefficients of the dense features, then of the entries of the vector, per unit and on the model's scale."""

    model_type: str
    alpha: float
    features: tuple[str, ...]
    vector: str
    target: str
    coefficients: np.ndarray
    raw_coefficients: np.ndarray
    raw_intercept: float
    n: int
    steps: int
    converged: bool

    def coefficient_table(self, df: DataFrame) -> DataFrame:
        """(position, coef_std, coef_raw), a row a coefficient, for the session of ``df``."""
        table = pa.table(
            {
                "position": pa.array(np.arange(len(self.coefficients)), pa.int64()),
                "coef_std": self.coefficients,
                "coef_raw": self.raw_coefficients,
            }
        )
        return df.sparkSession.createDataFrame(table)


@dataclass(frozen=True)
class _Batch:
    """Rows as arrays: the dense part, the entries of the vector with their rows, the target."""

    dense: np.ndarray
    place: np.ndarray
    value: np.ndarray
    row: np.ndarray
    y: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        m = self.dense.shape[1]
        found = self.dense @ weights[:m]
        found += np.bincount(self.row, self.value * weights[m + self.place], minlength=len(found))
        return found

    def back(self, r: np.ndarray, k: int) -> np.ndarray:
        """Sum over the rows of r times the row."""
        m = self.dense.shape[1]
        return np.concatenate([r @ self.dense, np.bincount(self.place, self.value * r[self.row], minlength=k - m)])


def _batch(batch: pa.RecordBatch, m: int) -> _Batch:
    dense = batch.column("dense").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, m)
    places = batch.column("indices")
    sizes = np.diff(places.offsets.to_numpy())
    return _Batch(
        dense,
        places.flatten().to_numpy(zero_copy_only=False),
        batch.column("values").flatten().to_numpy(zero_copy_only=False),
        np.repeat(np.arange(batch.num_rows), sizes),
        batch.column("y").to_numpy(zero_copy_only=False),
    )


def _summed(rows: DataFrame, m: int, size: int, of: Callable[[_Batch], np.ndarray]) -> np.ndarray:
    """The sum of ``of`` over all batches: per task, then per adder, then here."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_batch(batch, m))
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column("part").to_pylist():
                total += np.frombuffer(raw)
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    parts = rows.mapInArrow(partial, "part binary").repartition(ADDERS).mapInArrow(add, "part binary")
    return sum((np.frombuffer(r["part"]) for r in parts.collect()), np.zeros(size))


class _Design:
    """Scaled rows as a linear map: products with their Gram matrix, a pass each."""

    def __init__(self, rows: DataFrame, m: int, standardize: bool):
        self.rows, self.m = rows, m
        bad, n, size = rows.agg(
            F.count_if(F.exists("dense", lambda x: x.isNull() | F.isnan(x)) | F.col("y").isNull() | F.isnan("y")),
            F.count("*"), F.max("size"),
        ).first()
        if not n:
            raise ValueError("no rows to fit a model on")
        if bad:
            raise ValueError(f"{bad} rows have a null in a feature or the target")
        self.n, self.k = n, m + int(size or 0)
        if self.k > MAX_COEFFICIENTS:
            raise ValueError(f"{self.k} coefficients; a model has {MAX_COEFFICIENTS} at most")
        k = self.k

        def first(b: _Batch) -> np.ndarray:
            return np.append(b.back(np.ones(len(b.y)), k), b.y.sum())

        means = _summed(rows, m, k + 1, first) / n
        self.mean, self.y_mean = means[:k], means[k]
        centre = self.mean[:m]

        def second(b: _Batch) -> np.ndarray:
            gap = b.y - means[k]
            own = b.dense - centre
            entries = np.bincount(b.place, b.value * b.value, minlength=k - m)
            return np.concatenate([(own * own).sum(axis=0), entries, [gap @ gap]])

        spread = _summed(rows, m, k + 1, second) / n
        spread[m:k] = np.maximum(spread[m:k] - self.mean[m:] ** 2, 0.0)
        sd = np.sqrt(spread)
        #: A constant column has no say.
        self.live = sd[:k] > 1e-12 * np.maximum(1.0, np.abs(self.mean))
        scale = np.where(sd > 0, sd, 1.0) if standardize else np.ones(k + 1)
        self.scale, self.y_scale = np.where(self.live, scale[:k], 1.0), float(scale[k])

    def _pass(self, weights: np.ndarray | None) -> np.ndarray:
        """X'(X w) / n over the scaled rows, or X'y / n without weights."""
        context = self.rows.sparkSession.sparkContext
        k, y_mean = self.k, self.y_mean
        raw = None if weights is None else np.where(self.live, weights, 0.0) / self.scale
        shift = 0.0 if raw is None else float(raw @ self.mean)
        sent = context.broadcast(raw)

        def of(b: _Batch) -> np.ndarray:
            r = b.y - y_mean if sent.value is None else b.dot(sent.value) - shift
            return np.append(b.back(r, k), r.sum())

        found = _summed(self.rows, self.m, k + 1, of)
        sent.destroy()
        out = (found[:k] - self.mean * found[k]) / self.scale / self.n
        return np.where(self.live, out, 0.0)

    def pull(self) -> np.ndarray:
        return self._pass(None) / self.y_scale

    def gram(self, weights: np.ndarray) -> np.ndarray:
        return self._pass(weights)


def conjugate_gradients(
    times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, tolerance: float = TOLERANCE, most: int = MAX_STEPS
) -> tuple[np.ndarray, int, bool]:
    """(x, steps, settled) of times(x) = b, a symmetric and not negative map; shortest x if there are several."""
    x, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), float(r @ r)
    goal = tolerance * np.sqrt(rr)
    for step in range(most):
        if np.sqrt(rr) <= goal:
            return x, step, True
        q = times(p)
        curve = float(p @ q)
        if curve <= 0:  # only rounding is left
            return x, step, np.sqrt(rr) <= 1e3 * goal
        x += rr / curve * p
        r -= rr / curve * q
        rr, before = float(r @ r), rr
        p = r + rr / before * p
    return x, most, False


def proximal_steps(
    times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, alpha: float, tolerance: float, most: int
) -> tuple[np.ndarray, int, bool]:
    """(w, steps, settled) of the least w'Gw / 2 - b'w + alpha * |w|, by accelerated steps that start anew when they overshoot."""
    probe = np.random.default_rng(5).normal(size=len(b))
    largest, steps = 1.0, 0
    for _ in range(20):
        probe /= max(float(np.linalg.norm(probe)), 1e-300)
        found = times(probe)
        steps += 1
        largest, before = float(np.linalg.norm(found)), largest
        probe = found
        if abs(largest - before) <= 1e-3 * largest:
            break
    rate = 1.0 / max(1.05 * largest, 1e-300)
    w, y, t = np.zeros_like(b), np.zeros_like(b), 1.0
    while steps < most:
        move = y - rate * (times(y) - b)
        steps += 1
        new = np.sign(move) * np.maximum(np.abs(move) - rate * alpha, 0.0)
        if np.abs(new - y).max(initial=0.0) <= tolerance * max(1.0, np.abs(new).max(initial=0.0)):
            return new, steps, True
        if (y - new) @ (new - w) > 0:
            t, y = 1.0, new.copy()
        else:
            ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y = new + (t - 1) / ahead * (new - w)
            t = ahead
        w = new
    return w, steps, False


def fit_sparse(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    vector: str = "fixed_effects",
    model_type: str = "ols",
    alpha: float | None = None,
    standardize: bool = True,
    tolerance: float = TOLERANCE,
    max_steps: int = MAX_STEPS,
) -> SparseModel:
    """A model of dense columns and the entries of one sparse vector, with an intercept.

    ``vector`` is a struct of size, indices and values, as ``encode.add_sparse_effects`` makes it; a null one has no
    entries. A null in a feature or the target is an error. Where the steps end before the fit has settled, the best weights are returned and
    ``converged`` is false.
    """
    if model_type not in DEFAULT_ALPHA:
        raise ValueError(f"unknown model type {model_type!r}: use {', '.join(DEFAULT_ALPHA)}")
    require_columns(df, [*features, target, vector])
    alpha = DEFAULT_ALPHA[model_type] if alpha is None else float(alpha)
    m = len(features)
    numbers = [F.col(c).cast("double") for c in features]
    entry = F.col(vector)
    rows = df.select(
        (F.array(*numbers) if m else F.array().cast("array<double>")).alias("dense"),
        F.coalesce(entry["size"], F.lit(0)).cast("long").alias("size"),
        F.coalesce(entry["indices"].cast("array<long>"), F.array().cast("array<long>")).alias("indices"),
        F.coalesce(entry["values"].cast("array<double>"), F.array().cast("array<double>")).alias("values"),
        F.col(sql.name(target)).cast("double").alias("y"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        design = _Design(rows, m, standardize)
        b = design.pull()
        if model_type == "lasso":
            weights, steps, settled = proximal_steps(design.gram, b, alpha, tolerance, max_steps)
        else:
            shrink = alpha / design.n if model_type == "ridge" else 0.0
            weights, steps, settled = conjugate_gradients(
                lambda p: design.gram(p) + shrink * p, b, tolerance, max_steps
            )
    finally:
        rows.unpersist()
    if not settled:
        log.warning("the %s fit did not settle in %d steps", model_type, steps)
    raw = weights * design.y_scale / design.scale
    return SparseModel(
        model_type, alpha, tuple(features), vector, target, weights, raw,
        float(design.y_mean - raw @ design.mean), design.n, steps, settled,
    )
