"""Linear models on Spark-computed statistics: fit, predict, evaluate, coefficients.

The rows are touched by Spark only: one pass for the statistics, expressions for the
predictions, one aggregation for the metrics. What is solved on the driver is k x k.
Coefficients of nearly collinear features are less certain than the fitted values,
since the covariance squares the condition number; ``rank`` tells when it is short.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions import sql_text as sql
from spendlens.operators.checks import require_columns
from spendlens.operators.moments import Moments, regression_moments
from spendlens.operators.nulls import fill_zero
from spendlens.operators.tables import small_table

log = logging.getLogger(__name__)

# Default penalty per model type, and the iteration limit of the lasso.
DEFAULT_ALPHA = {"ols": 0.0, "ridge": 1.0, "lasso": 0.01}
LASSO_MAX_ITERATIONS = 10_000

RANK_TOLERANCE = 1e-10
LASSO_TOLERANCE = 1e-12

METRICS_SCHEMA = (
    "model_type string, r2 double, rmse double, mae double, mse double, rank int, n long"
)
MODEL_SCHEMA = (
    "model_type string, alpha double, target string, position int, feature string, "
    "coefficient double, x_mean double, x_scale double, y_mean double, y_scale double, "
    "feature_mean double, target_mean double, intercept double, rank int, n long"
)


@dataclass(frozen=True)
class LinearModel:
    """A fitted model; k numbers per field. Coefficients are on the model scale.

    ``x_mean`` to ``y_scale`` lead to that scale and are 0 and 1 for an unscaled fit;
    ``feature_means`` and ``target_mean`` are those of the training rows in any case.
    """

    model_type: str
    alpha: float
    features: tuple[str, ...]
    target: str
    coefficients: np.ndarray
    intercept: float
    x_mean: np.ndarray
    x_scale: np.ndarray
    y_mean: float
    y_scale: float
    feature_means: np.ndarray
    target_mean: float
    rank: int
    n: int
    #: False where an iteration was ended at its limit: the weights are the best so far.
    converged: bool = True

    @property
    def raw_coefficients(self) -> np.ndarray:
        return self.coefficients * self.y_scale / self.x_scale

    @property
    def raw_intercept(self) -> float:
        shift = float(self.raw_coefficients @ self.x_mean)
        return self.y_mean + self.y_scale * self.intercept - shift

    def coefficient(self, feature: str, scale: str = "model") -> float:
        if feature not in self.features:
            raise ValueError(f"feature {feature} is not in the model")
        return float(self.by_scale(scale)[self.features.index(feature)])

    def by_scale(self, scale: str) -> np.ndarray:
        _check_scale(scale)
        return self.coefficients if scale == "model" else self.raw_coefficients


def _check_scale(scale: str) -> None:
    if scale not in ("model", "original"):
        raise ValueError(f"unknown scale {scale!r}: use 'model' or 'original'")


def design(
    df: DataFrame, features: Sequence[str], target: str, handle_null: str = "error"
) -> DataFrame:
    """Features and target only.

    ``zero`` fills null features, ``drop`` leaves incomplete rows out, and ``error``
    lets the fit fail on any null. A null target fails the fit unless dropped.
    """
    require_columns(df, [*features, target])
    data = df.select(*features, target)
    if handle_null == "zero":
        return fill_zero(data, features)
    if handle_null == "drop":
        return data.dropna("any")
    if handle_null == "error":
        return data
    raise ValueError(f"unknown null handling {handle_null!r}: use 'error', 'zero' or 'drop'")


def fit(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    model_type: str = "ols",
    alpha: float | None = None,
    standardize: bool = True,
    handle_null: str = "error",
) -> LinearModel:
    """Fit one model with an intercept."""
    _check_type(model_type)
    data = design(df, features, target, handle_null)
    return solve(regression_moments(data, features, target), model_type, alpha, standardize)


def _check_type(model_type: str) -> None:
    if model_type not in DEFAULT_ALPHA:
        raise ValueError(f"unknown model type {model_type!r}: use {', '.join(DEFAULT_ALPHA)}")


def solve(
    moments: Moments,
    model_type: str = "ols",
    alpha: float | None = None,
    standardize: bool = True,
) -> LinearModel:
    """Solve a model from statistics; many models can share one pass over the rows.

    With ``standardize`` features and target have mean 0 and population deviation 1
    first (a constant column keeps deviation 1), and the coefficients are theirs.
    """
    _check_type(model_type)
    alpha = DEFAULT_ALPHA[model_type] if alpha is None else float(alpha)
    k = len(moments.features)
    unit = moments.scale
    scale = unit if standardize else np.ones(k + 1)
    cov = moments.cov / np.outer(scale, scale)
    xx, xy = cov[:k, :k], cov[:k, k]
    values = np.linalg.eigvalsh((moments.cov / np.outer(unit, unit))[:k, :k])
    rank = int((values > RANK_TOLERANCE * max(values.max(), 0.0)).sum()) if values.max() > 0 else 0
    converged = True
    if model_type == "ols":
        weights = _minimum_norm(xx, xy, unit[:k] / scale[:k], rank)
    elif model_type == "ridge":
        weights = np.linalg.solve(moments.n * xx + alpha * np.eye(k), moments.n * xy) if alpha else (
            _minimum_norm(xx, xy, unit[:k] / scale[:k], rank)
        )
    else:
        weights, converged = _soft_threshold_descent(xx, xy, alpha)
    x_mean = moments.mean[:k] if standardize else np.zeros(k)
    y_mean = float(moments.mean[k]) if standardize else 0.0
    intercept = 0.0 if standardize else float(moments.mean[k] - weights @ moments.mean[:k])
    return LinearModel(
        model_type, alpha, moments.features, moments.target, weights, intercept,
        x_mean, scale[:k].copy(), y_mean, float(scale[k]),
        moments.mean[:k].copy(), float(moments.mean[k]), rank, moments.n, converged,
    )


def _minimum_norm(xx: np.ndarray, xy: np.ndarray, spread: np.ndarray, rank: int) -> np.ndarray:
    """The least-squares solution; the shortest one when features are collinear."""
    if rank == len(xy):
        scaled = np.linalg.solve(xx / np.outer(spread, spread), xy / spread)
        return scaled / spread
    values, vectors = np.linalg.eigh(xx)
    kept = values > RANK_TOLERANCE * max(values.max(), 0.0) if values.max() > 0 else values > 0
    inverse = np.where(kept, 1.0 / np.where(kept, values, 1.0), 0.0)
    return vectors @ (inverse * (vectors.T @ xy))


def _soft_threshold_descent(xx: np.ndarray, xy: np.ndarray, alpha: float) -> tuple[np.ndarray, bool]:
    """Lasso by coordinate descent on the covariance: SSE / 2n + alpha * |w|; and whether it settled."""
    weights = np.zeros(len(xy))
    gradient = xy.copy()  # xy - xx @ weights
    curvature = np.diag(xx)
    for _ in range(LASSO_MAX_ITERATIONS):
        largest_step = 0.0
        for j in np.flatnonzero(curvature > 0):
            pull = gradient[j] + curvature[j] * weights[j]
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / curvature[j]
            step = new - weights[j]
            if step:
                gradient -= xx[:, j] * step
                weights[j] = new
                largest_step = max(largest_step, abs(step) * np.sqrt(curvature[j]))
        if largest_step <= LASSO_TOLERANCE:
            return weights, True
    log.warning("the lasso did not settle in %d sweeps", LASSO_MAX_ITERATIONS)
    return weights, False


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "_std") -> DataFrame:
    """Add (x - mean) / population deviation; a constant column is only centred."""
    require_columns(df, columns)
    stats = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[
            F.when(F.min(c) == F.max(c), 0.0).otherwise(F.stddev_pop(c)).alias(f"sd_{c}")
            for c in columns
        ],
    ).first()
    out = {}
    for c in columns:
        if stats[f"mean_{c}"] is None:
            out[c + suffix] = F.lit(None).cast("double")
            continue
        out[c + suffix] = (F.col(c) - F.lit(stats[f"mean_{c}"])) / F.lit(stats[f"sd_{c}"] or 1.0)
    return df.withColumns(out)


def prediction(model: LinearModel, scale: str = "original") -> Column:
    """The model as a column expression, on the target's or on the model's scale."""
    _check_scale(scale)
    weights, intercept = model.raw_coefficients, model.raw_intercept
    if scale == "model":
        weights = model.coefficients / model.x_scale
        intercept = model.intercept - float(weights @ model.x_mean)
    terms = [
        f"{sql.literal(float(w))} * {sql.name(c)}" for c, w in zip(model.features, weights)
    ]
    return F.expr(sql.total([sql.literal(float(intercept)), *terms]))


def predict(
    df: DataFrame, model: LinearModel, scale: str = "original", name: str = "prediction"
) -> DataFrame:
    """Add predictions; ``scale="model"`` leaves them standardised."""
    require_columns(df, model.features)
    return df.withColumn(name, prediction(model, scale))


def evaluate(
    df: DataFrame, models: LinearModel | Mapping[str, LinearModel], scale: str = "original"
) -> DataFrame:
    """R2, RMSE, MAE and MSE on ``df``, one row per model, in one pass for all.

    All of them are over the rows that have a target and every feature; ``n`` counts
    those. A constant target gives R2 1 for a perfect fit and else 0.
    """
    named = {models.model_type: models} if isinstance(models, LinearModel) else dict(models)
    aggregates = []
    for name, model in named.items():
        error = F.col(model.target).cast("double") - prediction(model, scale)
        seen = F.when(error.isNotNull(), F.col(model.target))
        aggregates += [
            (F.count(seen) * F.var_pop(seen)).alias(f"total_{name}"),
            (F.min(seen) == F.max(seen)).alias(f"constant_{name}"),
            F.count(error).alias(f"n_{name}"),
            F.sum(error * error).alias(f"squared_{name}"),
            F.sum(F.abs(error)).alias(f"absolute_{name}"),
        ]
    rows = []
    for name, model in named.items():
        n, squared = F.col(f"n_{name}"), F.col(f"squared_{name}")
        constant, total = F.col(f"constant_{name}"), F.col(f"total_{name}")
        r2 = F.when(
            constant, F.when(squared == 0, 1.0).otherwise(0.0)
        ).otherwise(F.lit(1.0) - F.try_divide(squared, total))
        mse = F.try_divide(squared, n)
        rows.append(
            F.struct(
                F.lit(name).alias("model_type"),
                r2.alias("r2"),
                F.sqrt(mse).alias("rmse"),
                F.try_divide(F.col(f"absolute_{name}"), n).alias("mae"),
                mse.alias("mse"),
                F.lit(model.rank).alias("rank"),
                n.alias("n"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def coefficient_table(spark: SparkSession, model: LinearModel) -> DataFrame:
    """Coefficients on both scales, the intercept last."""
    rows = [
        (i, f, float(s), float(r))
        for i, (f, s, r) in enumerate(
            zip(model.features, model.coefficients, model.raw_coefficients)
        )
    ]
    rows.append((len(rows), "intercept", float(model.intercept), model.raw_intercept))
    schema = "position int, feature string, coef_std double, coef_raw double"
    return small_table(spark, rows, schema)


def model_summary(spark: SparkSession, model: LinearModel, metrics: DataFrame) -> DataFrame:
    """Type, size and target of a model, its coefficients and its metrics, as rows."""
    found = metrics.where(F.col("model_type") == model.model_type).first()
    facts = [
        ("model", "type", model.model_type),
        ("model", "features", str(len(model.features))),
        ("model", "target", model.target),
    ]
    weights = [*zip(model.features, model.coefficients), ("intercept", model.intercept)]
    facts += [("coefficient", name, f"{float(w):.6f}") for name, w in weights]
    facts += [("metric", name, f"{found[name]:.4f}") for name in ("r2", "rmse", "mae", "mse")]
    return small_table(spark, facts, "section string, name string, value string")


def model_table(spark: SparkSession, model: LinearModel) -> DataFrame:
    """All that is needed to load the model again, one row per feature."""
    rows = [
        (
            model.model_type, model.alpha, model.target, i, f, float(model.coefficients[i]),
            float(model.x_mean[i]), float(model.x_scale[i]), model.y_mean, model.y_scale,
            float(model.feature_means[i]), model.target_mean,
            model.intercept, model.rank, model.n,
        )
        for i, f in enumerate(model.features)
    ]
    return small_table(spark, rows, MODEL_SCHEMA)


def model_from_table(table: DataFrame) -> LinearModel:
    rows = table.orderBy("position").collect()
    if not rows:
        raise ValueError("the model table is empty")
    head = rows[0]

    def vector(name: str) -> np.ndarray:
        return np.array([r[name] for r in rows], dtype=float)

    return LinearModel(
        head["model_type"], head["alpha"], tuple(r["feature"] for r in rows), head["target"],
        vector("coefficient"), head["intercept"], vector("x_mean"), vector("x_scale"),
        head["y_mean"], head["y_scale"], vector("feature_mean"), head["target_mean"],
        head["rank"], head["n"],
    )


def compare_models(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    alphas: Mapping[str, float | None] | None = None,
    standardize: bool = True,
    handle_null: str = "error",
    scale: str = "original",
) -> DataFrame:
    """Metrics of OLS, ridge and lasso: one pass for all fits, one for all metrics."""
    data = design(df, features, target, handle_null)
    moments = regression_moments(data, features, target)
    kinds = alphas if alphas is not None else dict.fromkeys(DEFAULT_ALPHA)
    models = {kind: solve(moments, kind, alpha, standardize) for kind, alpha in kinds.items()}
    return evaluate(data, models, scale)
