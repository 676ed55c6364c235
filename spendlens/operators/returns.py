"""Business metrics of a fitted model: elasticity, contribution, returns, scenarios.

``coef_scale="model"`` combines the coefficients of the standardised fit with means
and totals on the original scale; ``"original"`` uses coefficients per unit of spend.
The tables say which was used.

Where a function takes ``df=None``, means and totals are those of the training rows, which
the model holds: no further pass over the data is needed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.columns import channel_of
from spendlens.operators.checks import require_columns
from spendlens.operators.regression import LinearModel
from spendlens.operators.tables import small_table


def _averages(df: DataFrame | None, model: LinearModel, features: Sequence[str]) -> DataFrame:
    """One row: the mean target as ``_y`` and the mean of each feature as ``_m_<name>``."""
    if df is not None:
        require_columns(df, [*features, model.target])
        return df.agg(
            F.avg(model.target).alias("_y"), *[F.avg(f).alias(f"_m_{f}") for f in features]
        )
    known = dict(zip(model.features, model.feature_means))
    missing = [f for f in features if f not in known]
    if missing:
        raise ValueError(f"features not in the model: {', '.join(missing)}")
    return SparkSession.active().range(1).select(
        F.lit(model.target_mean).alias("_y"),
        *[F.lit(float(known[f])).alias(f"_m_{f}") for f in features],
    )


def _rows_of(one_row: DataFrame, rows: list[Column], schema: str) -> DataFrame:
    """One output row per struct."""
    if not rows:
        return small_table(one_row.sparkSession, [], schema)
    return one_row.select(F.inline(F.array(*rows)))


def elasticity(
    df: DataFrame | None,
    model: LinearModel,
    features: Sequence[str] | None = None,
    coef_scale: str = "model",
) -> DataFrame:
    """coefficient * mean(feature) / mean(target); 0 where either mean is 0."""
    features = list(model.features if features is None else features)
    means = _averages(df, model, features)
    weights = dict(zip(model.features, model.by_scale(coef_scale)))
    rows = []
    for f in features:
        x, y = F.col(f"_m_{f}"), F.col("_y")
        value = F.when((x == 0) | (y == 0), 0.0).otherwise(
            F.lit(float(weights.get(f, 0.0))) * F.try_divide(x, y)
        )
        rows.append(
            F.struct(
                F.lit(f).alias("feature"),
                value.alias("elasticity"),
                F.lit(coef_scale).alias("coef_scale"),
            )
        )
    return _rows_of(means, rows, "feature string, elasticity double, coef_scale string")


def log_elasticity(
    df: DataFrame | None, model: LinearModel, log_features: Sequence[str], coef_scale: str = "model"
) -> DataFrame:
    """The same for log-spend features in the model, named by channel."""
    features = [f for f in log_features if f in model.features]
    table = elasticity(df, model, features, coef_scale)
    return table.select(channel_of("feature").alias("channel"), "*")


def contribution(
    df: DataFrame | None, model: LinearModel, coef_scale: str = "model"
) -> DataFrame:
    """Share of the mean target explained by each feature, in percent, largest first."""
    means = _averages(df, model, model.features)
    rows = []
    for f, w in zip(model.features, model.by_scale(coef_scale)):
        effect = F.lit(float(w)) * F.col(f"_m_{f}")
        share = F.when(F.col("_y") == 0, 0.0).otherwise(F.try_divide(effect, F.col("_y")) * 100)
        rows.append(
            F.struct(
                F.lit(f).alias("feature"),
                share.alias("contribution_pct"),
                F.lit(coef_scale).alias("coef_scale"),
            )
        )
    schema = "feature string, contribution_pct double, coef_scale string"
    return _rows_of(means, rows, schema).orderBy(F.desc("contribution_pct"), "feature")


def top_elasticity(table: DataFrame, n: int = 5) -> DataFrame:
    return table.orderBy(F.desc(F.abs("elasticity")), "feature").limit(n)


def top_contribution(table: DataFrame, n: int = 5) -> DataFrame:
    return table.orderBy(F.desc("contribution_pct"), "feature").limit(n)


def spend_column_of(feature: str, raw: DataFrame | None) -> str | None:
    """The raw spend column of a feature: its own name, else that without a final ``_log``."""
    known = [] if raw is None else raw.columns
    return next((c for c in (feature, feature.removesuffix("_log")) if c in known), None)


def marginal_roas(
    df: DataFrame | None,
    model: LinearModel,
    spend_features: Sequence[str],
    raw_spend: DataFrame | None = None,
    coef_scale: str = "model",
) -> DataFrame:
    """coefficient * total sales / total spend per channel, largest first.

    Spend is the total of the raw column where there is one (``spend_basis`` total);
    else the mean of the feature, undone from its logarithm (``spend_basis`` mean).
    Features outside the model and channels without positive spend are left out.
    """
    used = [f for f in spend_features if f in model.features]
    basis = {f: spend_column_of(f, raw_spend) for f in used}
    measured = [f for f in used if basis[f] is not None]
    approximated = [f for f in used if basis[f] is None]
    spend: dict[str, float | None] = {}
    if measured:
        totals = raw_spend.agg(*[F.sum(basis[f]).alias(f) for f in measured]).first()
        spend.update({f: totals[f] for f in measured})
    means = dict(zip(model.features, model.feature_means))
    total_sales: float | None = model.target_mean * model.n
    if df is not None:
        require_columns(df, [model.target, *approximated])
        found = df.agg(
            F.sum(model.target).cast("double").alias("_sales"),
            *[F.avg(f).alias(f) for f in approximated],
        ).first()
        total_sales = found["_sales"]
        means = {f: found[f] for f in approximated}
    for f in approximated:
        undone = f.endswith("_log") and means[f] is not None
        spend[f] = math.expm1(means[f]) if undone else means[f]
    rows = [
        (
            f, model.coefficient(f, coef_scale), total_sales, float(spend[f]),
            "total" if f in measured else "mean", coef_scale,
        )
        for f in used
        if total_sales is not None and spend[f] is not None and spend[f] > 0
    ]
    schema = (
        "feature string, coefficient double, total_sales double, total_spend double, "
        "spend_basis string, coef_scale string"
    )
    table = small_table(SparkSession.active(), rows, schema)
    mroas = F.col("coefficient") * (F.col("total_sales") / F.col("total_spend"))
    return (
        table.withColumn("channel", channel_of("feature"))
        .withColumn("mroas", mroas)
        .withColumn(
            "mroas_interpretation", F.format_string("$%.2f revenue per $1 spend", "mroas")
        )
        .select(
            "feature", "channel", "coefficient", "total_sales", "total_spend", "mroas",
            "spend_basis", "coef_scale", "mroas_interpretation",
        )
        .orderBy(F.desc("mroas"), "feature")
    )


def promo_impact(
    df: DataFrame | None,
    model: LinearModel,
    promo_features: Sequence[str],
    coef_scale: str = "model",
) -> DataFrame:
    """Coefficient per promotion feature; has_promotion times the mean target."""
    used = [f for f in promo_features if f in model.features]
    rows = []
    for f in used:
        weight = F.lit(model.coefficient(f, coef_scale))
        impact = weight * F.col("_y") if f == "has_promotion" else weight
        rows.append(
            F.struct(
                F.lit(f).alias("feature"), weight.alias("coefficient"), impact.alias("impact")
            )
        )
    schema = "feature string, coefficient double, impact double"
    return _rows_of(_averages(df, model, []), rows, schema)


def scenario_lift(
    raw_spend: DataFrame,
    model: LinearModel,
    spend_factors: Mapping[str, float],
    coef_scale: str = "model",
) -> DataFrame:
    """What a change of spend does: ``{spend column: factor}``.

    The lift of a log-spend feature is coefficient * ln(factor).
    """
    require_columns(raw_spend, list(spend_factors))
    for column, factor in spend_factors.items():
        if factor <= 0:
            raise ValueError(f"the factor of {column} must be positive, not {factor}")
    rows = []
    for column, factor in spend_factors.items():
        weight = F.lit(model.coefficient(f"{column}_log", coef_scale))
        lift = weight * F.log(F.lit(float(factor)))
        rows.append(
            F.struct(
                F.lit(column).alias("spend_column"),
                F.lit(float(factor)).alias("factor"),
                F.col(f"_t_{column}").alias("current_spend"),
                (F.col(f"_t_{column}") * factor).alias("scenario_spend"),
                weight.alias("coefficient"),
                lift.alias("lift"),
                (lift * 100).alias("lift_pct"),
            )
        )
    totals = [F.sum(c).alias(f"_t_{c}") for c in spend_factors]
    schema = (
        "spend_column string, factor double, current_spend double, scenario_spend double, "
        "coefficient double, lift double, lift_pct double"
    )
    if not rows:
        return small_table(raw_spend.sparkSession, [], schema)
    return _rows_of(raw_spend.agg(*totals), rows, schema)
