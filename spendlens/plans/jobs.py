"""The three jobs: spend model, full model, and the configured run of all steps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from spendlens.operators.effects import EffectsModel, evaluate_effects, fit_effects
from spendlens.operators.features import balanced_features
from spendlens.operators.nulls import fill_zero
from spendlens.operators.regression import (
    METRICS_SCHEMA,
    LinearModel,
    coefficient_table,
    design,
    evaluate,
    fit,
)
from spendlens.operators.returns import (
    contribution,
    elasticity,
    log_elasticity,
    marginal_roas,
    promo_impact,
)
from spendlens.operators.tables import small_table
from spendlens.plans.preprocess import Prepared, preprocess, with_defaults
from spendlens.session import shared_root
from spendlens.sources.readers import import_metadata, import_panel
from spendlens.sources.writers import export_by_config

# The model of the configured run.
RUN_MODEL_TYPE = "ridge"
RUN_ALPHA = 1.0

RESULT_SCHEMA = "section string, name string, value string"


@dataclass(frozen=True)
class FittedJob:
    """A fitted model with the rows it was fitted on and the table they came from.

    ``data`` holds features and target only and is persisted: the fit and the metrics
    read it. The wide feature table is not; it is computed once, when written.
    """

    prepared: Prepared
    data: DataFrame
    features: list[str]
    model: LinearModel
    #: The geo effects of a model that has them as a table; ``model`` is its part without them.
    effects: EffectsModel | None = None

    def metrics(self) -> DataFrame:
        """Metrics on the rows of the fit, geo effects included."""
        if self.effects is None:
            return evaluate(self.data, self.model)
        return evaluate_effects(self.data, self.effects)

    def close(self) -> None:
        self.data.unpersist()


def _fit_job(
    prepared: Prepared,
    features: Sequence[str],
    model_type: str,
    alpha: float | None,
    handle_null: str,
) -> FittedJob:
    target = prepared.sets["target"][0]
    data = design(prepared.df, features, target, handle_null)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    model = fit(data, features, target, model_type, alpha)
    return FittedJob(prepared, data, list(features), model)


def fit_spend_model(
    raw: DataFrame,
    config: Mapping[str, Any] | None = None,
    model_type: str = RUN_MODEL_TYPE,
    alpha: float | None = RUN_ALPHA,
    handle_null: str = "error",
) -> FittedJob:
    """Preprocess, then fit revenue on the raw spend columns."""
    prepared = preprocess(raw, config)
    return _fit_job(
        prepared, prepared.sets["spend_features"], model_type, alpha, handle_null
    )


def fit_full_model(
    raw: DataFrame,
    config: Mapping[str, Any] | None = None,
    model_type: str = "ols",
    alpha: float | None = None,
    n_geo: int | None = None,
    n_seasonal: int | None = None,
) -> FittedJob:
    """Preprocess, then fit revenue on the balanced feature list, nulls read as 0.

    All geo and seasonal effects are in it, unless ``n_geo`` or ``n_seasonal`` asks for
    the first few. With ``fixed_effects_form="vector"`` the geo effects are eliminated: the same model (OLS or ridge)
    for any number of geos, with the effects as a table in ``effects``.
    """
    prepared = preprocess(raw, config)
    features = balanced_features(prepared.sets, n_geo, n_seasonal)
    settings = with_defaults(config)
    if settings["create_fixed_effects"] and settings["fixed_effects_form"] == "vector" and "geo" in prepared.df.columns:
        if n_geo is not None:
            raise ValueError("n_geo keeps the first of the columns; a vector has all effects")
        target = prepared.sets["target"][0]
        data = fill_zero(prepared.df.select("geo", *features, target), features)
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        fitted = fit_effects(data, features, target, "geo", model_type, alpha)
        return FittedJob(prepared, data, list(features), fitted.model, fitted)
    return _fit_job(prepared, features, model_type, alpha, "zero")


def full_analysis(raw: DataFrame, config: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """Everything the full model tells, as tables of a few rows each.

    The prepared rows are read twice, for the fit and for the metrics; means and sales
    come with the model, spend totals from ``raw``.
    """
    job = fit_full_model(raw, config)
    model, sets = job.model, job.prepared.sets
    try:
        metrics = small_table(raw.sparkSession, job.metrics().collect(), METRICS_SCHEMA)
    finally:
        job.close()
    return {
        "coefficients": coefficient_table(raw.sparkSession, model),
        "metrics": metrics,
        "mroas": marginal_roas(None, model, sets["spend_features_log"], raw),
        "elasticity": log_elasticity(None, model, sets["spend_features_log"]),
        "promo_impact": promo_impact(None, model, sets["promotional_features"]),
    }


def _step(config: Mapping[str, Any], name: str, shared: str) -> dict[str, Any] | None:
    """Settings of a step, the shared section over its own; None if switched off."""
    step = config.get("steps", {}).get(name, {})
    if not step.get("enabled", True):
        return None
    return {**(step.get("config") or {}), **(config.get(shared) or {})}


def run(
    spark: SparkSession,
    config: Mapping[str, Any],
    panel: DataFrame | None = None,
    results: dict[str, Any] | None = None,
) -> dict[str, Any]:
    """Import, train, evaluate and export, each step if it is switched on.

    A ``panel`` stands in for a switched-off import. The results are nested and small:
    counts, metrics and one number per channel. A failing step raises; pass a
    ``results`` dict to see how far the run came.
    """
    results = {} if results is None else results
    status = results.setdefault("run", {})
    status["start_time"] = dt.datetime.now(dt.timezone.utc).isoformat()
    try:
        _run_steps(spark, config, panel, results)
    except Exception as error:
        status.update(status="FAILED", error=str(error))
        raise
    status.update(status="SUCCESS", end_time=dt.datetime.now(dt.timezone.utc).isoformat())
    return results


def _run_steps(
    spark: SparkSession,
    config: Mapping[str, Any],
    panel: DataFrame | None,
    results: dict[str, Any],
) -> None:
    data_config = _step(config, "data_import", "data")
    if data_config is not None:
        # Written once: everything after reads this, not the source and its join.
        shared_root(spark)
        panel = import_panel(spark, **data_config).checkpoint()
        found = import_metadata(panel).first()
        results["data_import"] = {
            "status": "SUCCESS",
            "shape": [found["n_rows"], found["n_columns"]],
            "date_range": {"start": found["week_start"], "end": found["week_end"]},
        }
    model_config = _step(config, "model_training", "model")
    if model_config is None:
        return
    if panel is None:
        raise ValueError("training needs an import step or a panel")
    job = fit_spend_model(
        panel,
        config.get("preprocessing"),
        model_config.get("type", RUN_MODEL_TYPE),
        model_config.get("alpha", RUN_ALPHA),
        model_config.get("handle_null", "error"),
    )
    try:
        results["model_training"] = {
            "status": "SUCCESS",
            "model_type": job.model.model_type,
            "model_alpha": job.model.alpha,
        }
        if _step(config, "model_evaluation", "evaluation") is not None:
            results["model_evaluation"] = {"status": "SUCCESS", **_evaluation(job)}
        output = _step(config, "data_export", "output")
        if output is not None:
            table = results_table(spark, results)
            files = export_by_config(spark, job.prepared.df, job.model, table, output)
            results["data_export"] = {"status": "SUCCESS", "output_files": files}
    finally:
        job.close()


def _evaluation(job: FittedJob) -> dict[str, dict[str, float]]:
    metrics = job.metrics().first()
    shares = contribution(None, job.model).collect()
    sensitivities = elasticity(None, job.model).collect()
    return {
        "model_metrics": {
            "r2_score": metrics["r2"],
            "rmse": metrics["rmse"],
            "mae": metrics["mae"],
            "mse": metrics["mse"],
        },
        "elasticity": {r["feature"]: r["elasticity"] for r in sensitivities},
        "contribution": {r["feature"]: r["contribution_pct"] for r in shares},
    }


def results_table(spark: SparkSession, results: Mapping[str, Any]) -> DataFrame:
    """The nested results as rows (section, name, value), names joined by dots."""
    rows: list[tuple[str, str, str]] = []

    def add(section: str, name: str, value: Any) -> None:
        if isinstance(value, Mapping):
            for key, inner in value.items():
                add(section, f"{name}.{key}" if name else str(key), inner)
        elif isinstance(value, (list, tuple)):
            for i, inner in enumerate(value):
                add(section, f"{name}.{i}", inner)
        else:
            rows.append((section, name, None if value is None else str(value)))

    for section, content in results.items():
        add(section, "", content)
    return small_table(spark, rows, RESULT_SCHEMA)


def summary_table(spark: SparkSession, results: Mapping[str, Any], top: int = 5) -> DataFrame:
    """The short report: status, shape, model, metrics, and the strongest channels."""
    short = {k: v for k, v in results.items() if k != "data_export"}
    judged = short.get("model_evaluation")
    if judged:
        by_size = sorted(judged["elasticity"].items(), key=lambda kv: -abs(kv[1]))[:top]
        by_value = sorted(judged["contribution"].items(), key=lambda kv: -kv[1])[:top]
        short["model_evaluation"] = {
            "status": judged["status"],
            "model_metrics": {
                k: v for k, v in judged["model_metrics"].items() if k != "mse"
            },
            "elasticity": dict(by_size),
            "contribution": dict(by_value),
        }
    return results_table(spark, short)
