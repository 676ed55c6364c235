"""Sufficient statistics of a linear regression, in one distributed pass.

All models (ordinary, ridge, lasso) and their squared-error metrics need only the
count, the means and the co-moments of the features and the target: k^2 numbers that
do not grow with the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendlens.functions import sql_text as sql
from spendlens.operators.checks import require_columns


@dataclass(frozen=True)
class Moments:
    """Means and population covariance of (features..., target) over ``n`` rows."""

    features: tuple[str, ...]
    target: str
    n: int
    mean: np.ndarray
    cov: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        """Population deviation of every column; 1 for a constant one."""
        sd = np.sqrt(np.diag(self.cov))
        return np.where(sd == 0, 1.0, sd)


def regression_moments(df: DataFrame, features: Sequence[str], target: str) -> Moments:
    """Gather the statistics. A null in a feature or the target is an error."""
    if not features:
        raise ValueError("a model needs at least one feature")
    if len(set(features)) < len(features) or target in features:
        raise ValueError("feature names must differ from each other and from the target")
    columns = [*features, target]
    require_columns(df, columns)
    numbers = df.selectExpr(
        *[f"CAST({sql.name(c)} AS DOUBLE) AS c{i}" for i, c in enumerate(columns)]
    )
    n, bad, mean, cov, constant = _gathered(numbers, len(columns))
    if n == 0:
        raise ValueError("no rows to fit a model on")
    if bad:
        raise ValueError(f"{bad} rows have a null in a feature or the target")
    cov, mean = cov.copy(), np.asarray(mean)
    cov[constant, :] = 0.0
    cov[:, constant] = 0.0
    return Moments(tuple(features), target, n, mean, cov)


def gram(df: DataFrame, k: int) -> tuple[int, np.ndarray]:
    """Rows of a table of k numbers, and the sums of their products; no row gives zeros."""
    n, _, mean, cov, _ = _gathered(df, k)
    return n, n * (cov + np.outer(mean, mean)) if n else np.zeros((k, k))


def _gathered(df: DataFrame, k: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Each task reduces its rows to k^2 numbers; those are merged as a tree.

    Products are taken around the mean of the rows at hand and corrected when two parts
    are merged, so they stay accurate when a mean is large against its spread. The
    merging functions are nested: Spark ships them by value, so workers need numpy and
    pyarrow only.
    """

    def merge(a: tuple, b: tuple) -> tuple:
        n_a, bad_a, mean_a, within_a, low_a, high_a = a
        n_b, bad_b, mean_b, within_b, low_b, high_b = b
        if n_a == 0 or n_b == 0:
            kept = b if n_a == 0 else a
            return (kept[0], bad_a + bad_b, *kept[2:])
        n = n_a + n_b
        gap = mean_b - mean_a
        return (
            n,
            bad_a + bad_b,
            mean_a + gap * (n_b / n),
            within_a + within_b + np.outer(gap, gap) * (n_a / n * n_b),
            np.minimum(low_a, low_b),
            np.maximum(high_a, high_b),
        )

    nothing = (0, 0, np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros(k))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = nothing
        for batch in batches:
            # One row of x per column: batches are columnar, so each is copied whole.
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            incomplete = np.isnan(x).any(axis=0)
            bad = int(incomplete.sum())
            if bad:
                x = x[:, ~incomplete]
            part = (0, bad, *nothing[2:])
            if x.shape[1]:
                mean = x.mean(axis=1)
                centred = x - mean[:, None]
                part = (
                    x.shape[1], bad, mean, centred @ centred.T, x.min(axis=1), x.max(axis=1),
                )
            total = merge(total, part)
        yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(total)]})

    partial = df.mapInArrow(summarise, "part binary")
    n, bad, mean, within, low, high = partial.rdd.map(
        lambda row: pickle.loads(bytes(row.part))
    ).treeAggregate(nothing, merge, merge, depth=3)
    cov = within / n if n else within
    return n + bad, bad, mean, (cov + cov.T) / 2, low == high
