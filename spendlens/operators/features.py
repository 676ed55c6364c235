"""Feature engineering on the panel, and the feature sets a model chooses from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from spendlens.functions.columns import cost_per_mille, has_value, log_plus_one
from spendlens.functions.promo_text import PROMO_TYPE_PATTERNS, discount_percent, promo_flags
from spendlens.operators.channels import Channels, numeric_columns
from spendlens.operators.series import Series, lag_columns
from spendlens.operators.tables import small_table

PROMO = "promo_description"
ORGANIC = "impression_organic"

FeatureSets = dict[str, list[str]]


def cpm_columns(channels: Channels) -> dict[str, Column]:
    """``cpm_<channel>`` for channels with both a cost and an impression column."""
    return {
        f"cpm_{name}": cost_per_mille(f"cost_{name}", f"impression_{name}")
        for name in channels.names
        if f"cost_{name}" in channels.cost_columns
        and f"impression_{name}" in channels.impression_columns
    }


def log_columns(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_log": log_plus_one(c) for c in columns}


def promo_columns(
    column: str = PROMO, patterns: Mapping[str, list[str]] | None = None
) -> dict[str, Column]:
    """Presence flag, one flag per promotion type, and the discount percentage."""
    return {
        "has_promotion": has_value(column),
        **promo_flags(column, dict(patterns) if patterns else None),
        "discount_percent": discount_percent(column),
    }


def promo_feature_names(patterns: Mapping[str, list[str]] | None = None) -> list[str]:
    """Promotion features of a model; the plain presence flag is not one of them."""
    return [*(patterns or PROMO_TYPE_PATTERNS), "discount_percent", "promo_intensity"]


def lag_names(cost_columns: Sequence[str], periods: Sequence[int]) -> dict[str, tuple[str, int]]:
    return {f"{c}_lag{k}": (c, k) for c in cost_columns for k in periods}


def add_spend_lags(
    series: Series, cost_columns: Sequence[str], periods: Sequence[int] = (1, 2)
) -> Series:
    """``<cost>_lag<k>``: spend k rows earlier in the same geo, 0 where there is none."""
    return lag_columns(series, lag_names(cost_columns, periods), fill=0.0)


def add_organic_lag(series: Series) -> Series:
    """``log_organic`` and its value one row earlier in the same geo."""
    logged = series.with_df(series.df.withColumn("log_organic", log_plus_one(ORGANIC)))
    return lag_columns(logged, {"log_organic_lag1": ("log_organic", 1)}, fill=0.0)


# The names of the sets, and the columns that always belong to two of them.
SET_NAMES = (
    "target", "spend_features", "spend_features_log", "lagged_spend_features",
    "impression_features", "control_vars", "promotional_features", "geo_fixed_effects",
    "week_fixed_effects", "seasonal_features", "all_features",
)
TARGET = "revenue"
CONTROLS = ["population", "market_share"]


def empty_sets() -> FeatureSets:
    """Sets that the preparation steps add their columns to."""
    return {name: [] for name in SET_NAMES} | {"target": [TARGET], "control_vars": list(CONTROLS)}


def numeric_features(df: DataFrame) -> list[str]:
    """Every double or long column but the target."""
    return [c for c in numeric_columns(df) if c != TARGET]


def feature_set_table(df: DataFrame, sets: FeatureSets) -> DataFrame:
    """The sets as rows (set_name, position, feature)."""
    rows = [
        (name, position, feature)
        for name, features in sets.items()
        for position, feature in enumerate(features)
    ]
    return small_table(
        df.sparkSession, rows, "set_name string, position int, feature string"
    )


def balanced_features(
    sets: FeatureSets, n_geo: int | None = None, n_seasonal: int | None = None
) -> list[str]:
    """Log spend, controls, promotions, geo effects and seasonality, in that order.

    ``n_geo`` and ``n_seasonal`` keep the first few of the last two sets.
    """
    return [
        *sets["spend_features_log"],
        *sets["control_vars"],
        *sets["promotional_features"],
        *sets["geo_fixed_effects"][:n_geo],
        *sets["seasonal_features"][:n_seasonal],
    ]
