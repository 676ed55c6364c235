"""Linear models with the effects of a category, for any number of its levels.

With one 0/1 column per level the moments of a model have (features + levels)^2 numbers. Here the
levels are eliminated instead: among themselves they are orthogonal, so their block of the normal equations is a
diagonal, and what is left is a system over the other features only. The sums of each
level are a table, and so are the effects: neither is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions import sql_text as sql
from spendlens.operators.checks import require_columns
from spendlens.operators.moments import gram, regression_moments
from spendlens.operators.nulls import fill_zero
from spendlens.operators.regression import DEFAULT_ALPHA, RANK_TOLERANCE, LinearModel, evaluate, predict
from spendlens.session import shared_root

#: What the effect of a row's level is called where it is a column.
EFFECT = "level_effect"


@dataclass(frozen=True)
class EffectsModel:
    """A model of a few features, and a table with the effects of ``column``.

    ``effects`` has (``column``, n, effect, coefficient), a row a level but the first in sorted order: its effect in units of the
    target, and the coefficient that its 0/1 column has on the model's scale. The first level and a null have none.
    """

    model: LinearModel
    column: str
    effects: DataFrame
    levels: int

    @property
    def with_effect(self) -> LinearModel:
        """The model with the effect as one more feature, whose coefficient is 1 per unit."""
        m = self.model
        return replace(
            m,
            features=(*m.features, EFFECT),
            coefficients=np.append(m.coefficients, 1.0 / m.y_scale),
            x_mean=np.append(m.x_mean, 0.0),
            x_scale=np.append(m.x_scale, 1.0),
            feature_means=np.append(m.feature_means, 0.0),
        )

    def joined(self, df: DataFrame) -> DataFrame:
        """``df`` with the effect of each row's level; nothing is hinted, the table's size decides."""
        own = self.effects.select(F.col(self.column).alias("_level"), F.col("effect").alias(EFFECT))
        found = df.join(own, df[self.column] == F.col("_level"), "left").drop("_level")
        return found.withColumn(EFFECT, F.coalesce(EFFECT, F.lit(0.0)))


def _design(
    df: DataFrame, features: Sequence[str], target: str, column: str, handle_null: str
) -> DataFrame:
    """The column, the features and the target; nulls of the column are a level without an effect."""
    require_columns(df, [*features, target, column])
    data = df.select(column, *features, target)
    if handle_null == "zero":
        return fill_zero(data, features)
    if handle_null == "drop":
        return data.dropna("any", subset=[*features, target])
    if handle_null == "error":
        return data
    raise ValueError(f"unknown null handling {handle_null!r}: use 'error', 'zero' or 'drop'")


def fit_effects(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    column: str = "geo",
    model_type: str = "ols",
    alpha: float | None = None,
    standardize: bool = True,
    handle_null: str = "error",
) -> EffectsModel:
    """The same model as ``fit`` on the features and a 0/1 column per level but the first.

    Equal in coefficients and fitted values, with collinear features too: of all least-squares
    solutions it is the one that is shortest over features *and* levels. ``ridge`` shrinks the effects as it
    would shrink their columns. A lasso has no such elimination, see ``operators.iterative``.
    """
    if model_type not in ("ols", "ridge"):
        raise ValueError(f"effects are eliminated for 'ols' and 'ridge', not for {model_type!r}")
    if column in features or column == target:
        raise ValueError(f"{column} is the category and can't be a feature or the target")
    alpha = DEFAULT_ALPHA[model_type] if alpha is None else float(alpha)
    alpha = 0.0 if model_type == "ols" else alpha
    data = _design(df, features, target, column, handle_null)
    moments = regression_moments(data, features, target)
    n, m, mean, unit = moments.n, len(features), moments.mean, moments.scale

    shared_root(df.sparkSession)
    centred = [
        f"SUM(CAST({sql.name(c)} AS DOUBLE) - {sql.literal(float(mean[i]))}) AS s{i}"
        for i, c in enumerate([*features, target])
    ]
    key = sql.name(column)
    sums = data.where(F.col(column).isNotNull()).groupBy(column).agg(
        *map(F.expr, centred), F.expr("CAST(COUNT(*) AS DOUBLE) AS rows")
    )
    # The first level has no effect: the others are held against it.
    sums = sums.checkpoint()
    first = sums.agg(F.min(column).alias("first")).first()["first"]
    others = sums.where(F.expr(f"{key} <> {sql.literal(first)}")) if first is not None else sums.limit(0)
    # Squared length of a level's coefficient on the model's scale, per unit of its effect.
    share = f"(rows / {float(n)!r}D)"
    length = f"({share} * (1 - {share}))" if standardize else "1.0D"
    others = others.withColumn("length", F.expr(length))
    others = others.withColumn("curve", F.expr(f"rows + {alpha!r}D * length"))
    # Features, the intercept (a level's rows) and the target.
    vector = [*[f"s{i}" for i in range(m)], "rows", f"s{m}"]
    kept = others.selectExpr(*[f"{v} / sqrt(curve) AS c{i}" for i, v in enumerate(vector)])
    levels, taken = gram(kept, m + 2)
    norm = others.selectExpr(*[f"{v} * sqrt(length) / curve AS c{i}" for i, v in enumerate(vector)])
    _, lengths = gram(norm, m + 2)

    whole = np.zeros((m + 2, m + 2))
    order = [*range(m), m + 1]
    whole[np.ix_(order, order)] = moments.cov * n
    whole[m, m] = n
    own = np.append(unit[:m] ** 2 if standardize else np.ones(m), 0.0)
    reduced = whole - taken
    solution, rank = _solve(
        reduced[: m + 1, : m + 1] + alpha * np.diag(own), reduced[: m + 1, m + 1], unit[:m], n, own, lengths
    )
    if alpha:  # the rank is that of the data, whatever the penalty
        plain = others.selectExpr(*[f"{v} / sqrt(rows) AS c{i}" for i, v in enumerate(vector)])
        bare = (whole - gram(plain, m + 2)[1])[: m + 1, : m + 1]
        rank = int(_spectrum(bare, unit[:m], n)[2].sum())
    slopes, shift = solution[:m], float(solution[m])

    y_scale = float(unit[m]) if standardize else 1.0
    x_scale = unit[:m].copy() if standardize else np.ones(m)
    x_mean, y_mean = (mean[:m].copy(), float(mean[m])) if standardize else (np.zeros(m), 0.0)
    intercept = shift / y_scale if standardize else float(mean[m] + shift - slopes @ mean[:m])
    model = LinearModel(
        model_type, alpha, tuple(features), target, slopes * x_scale / y_scale, intercept,
        x_mean, x_scale, y_mean, y_scale, mean[:m].copy(), float(mean[m]), rank - 1 + levels, n,
    )
    terms = [f"{sql.literal(float(-w))} * s{i}" for i, w in enumerate(slopes)]
    pull = sql.total([f"s{m}", f"{sql.literal(-shift)} * rows", *terms])
    effects = others.withColumn("effect", F.expr(f"({pull}) / curve")).select(
        column,
        F.col("rows").cast("long").alias("n"),
        "effect",
        (F.col("effect") * F.sqrt("length") / F.lit(y_scale)).alias("coefficient"),
    )
    return EffectsModel(model, column, effects, levels + (first is not None))


def _lengths(unit: np.ndarray, n: int) -> np.ndarray:
    """Of the columns of the features and of the intercept."""
    return np.sqrt(float(n)) * np.append(unit, 1.0)


def _spectrum(a: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, eigenvectors and which of them count, on columns of length 1."""
    values, vectors = np.linalg.eigh(a / np.outer(_lengths(unit, n), _lengths(unit, n)))
    return values, vectors, values > RANK_TOLERANCE * max(values.max(), 0.0)


def _solve(
    a: np.ndarray, b: np.ndarray, unit: np.ndarray, n: int, own: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, int]:
    """(slopes and intercept, rank) of a x = b, the shortest with what x implies for the levels.

    ``own`` and ``lengths`` give the squared length: sum of own * x^2, and the levels' share as a
    quadratic form of (x, -1). The levels follow from x, so a direction that leaves a x as it is moves them too.
    """
    k = len(b)
    scale, (values, vectors, kept) = _lengths(unit, n), _spectrum(a, unit, n)
    inverse = np.where(kept, 1.0 / np.where(kept, values, 1.0), 0.0)
    x = vectors @ (inverse * (vectors.T @ (b / scale))) / scale
    free = vectors[:, ~kept] / scale[:, None]
    if free.shape[1]:
        form = np.diag(own) + lengths[:k, :k]
        x = x - free @ np.linalg.lstsq(free.T @ form @ free, free.T @ (form @ x - lengths[:k, k]), rcond=None)[0]
    return x, int(kept.sum())


def predict_effects(df: DataFrame, fitted: EffectsModel, scale: str = "original", name: str = "prediction") -> DataFrame:
    """Add predictions; a level that the model has not seen counts as the first."""
    return predict(fitted.joined(df), fitted.with_effect, scale, name).drop(EFFECT)


def evaluate_effects(
    df: DataFrame, fitted: EffectsModel | Mapping[str, EffectsModel], scale: str = "original"
) -> DataFrame:
    """R2, RMSE, MAE and MSE on ``df``, one row per model."""
    named = {fitted.model.model_type: fitted} if isinstance(fitted, EffectsModel) else dict(fitted)
    rows = [evaluate(one.joined(df), {name: one.with_effect}, scale) for name, one in named.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
