"""From the raw panel to the feature table."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions import sql_text as sql
from spendlens.functions.columns import log_plus_one
from spendlens.operators.channels import Channels, discover_channels, drop_columns_like
from spendlens.operators.checks import largest_group
from spendlens.operators.encode import (
    Level,
    add_sparse_effects,
    calendar_dummies,
    distinct_levels,
    geo_dummies,
    level_counts,
    sorted_levels,
    week_dummies,
)
from spendlens.operators.features import (
    ORGANIC,
    PROMO,
    FeatureSets,
    cpm_columns,
    empty_sets,
    lag_names,
    log_columns,
    numeric_features,
    promo_columns,
    promo_feature_names,
)
from spendlens.operators.nulls import fill_column
from spendlens.operators.series import MAX_SERIES_ROWS, as_series, lag_columns, promo_intensity
from spendlens.sources.readers import parse_week

log = logging.getLogger(__name__)

# Settings and their defaults.
DEFAULT_CONFIG: dict[str, Any] = {
    "fill_tv_impressions": True,
    "remove_outdoor2": True,
    "log_transform": True,
    "handle_promotions": True,
    "fillna_method": "median",
    "create_lags": True,
    "lag_periods": [1, 2],
    "create_fixed_effects": True,
    # "columns": a 0/1 column per level; "vector": one sparse vector, for any number of levels.
    "fixed_effects_form": "columns",
    "create_seasonality": True,
    # Which column the first setting fills and which channel the second drops.
    "fill_columns": ["impression_tv"],
    "drop_patterns": ["outdoor2"],
    # Columns that order the rows of one geo and week, for lags and fills; the promotion
    # text if none is named.
    "tie_break": None,
    # Rows of a series kept in one task.
    "max_series_rows": MAX_SERIES_ROWS,
}


@dataclass(frozen=True)
class Prepared:
    """The feature table with the names that describe it."""

    df: DataFrame
    channels: Channels
    sets: FeatureSets
    steps: list[str] = field(default_factory=list)


def with_defaults(config: Mapping[str, Any] | None) -> dict[str, Any]:
    """Settings merged over the defaults, so a partial config is enough."""
    given = dict(config or {})
    unknown = sorted(set(given) - set(DEFAULT_CONFIG))
    if unknown:
        log.warning("ignoring unknown settings: %s", ", ".join(unknown))
    return {**DEFAULT_CONFIG, **{k: v for k, v in given.items() if k in DEFAULT_CONFIG}}


def preprocess(df: DataFrame, config: Mapping[str, Any] | None = None) -> Prepared:
    """Fill, drop, derive, lag and encode; see :data:`DEFAULT_CONFIG` for the switches.

    The result is one lazy plan. Three small facts are fetched first, since they are
    part of it: the median, the levels of geo and week, and the longest series.
    """
    settings = with_defaults(config)
    steps: list[str] = []
    sets = empty_sets()
    if "week" in df.columns:
        df = parse_week(df)
    keyed = "geo" in df.columns and "week" in df.columns
    ties = settings["tie_break"]
    if ties is None:
        ties = [PROMO] if PROMO in df.columns else []
    order = ["week", *ties]

    if settings["fill_tv_impressions"]:
        for column in settings["fill_columns"]:
            if column in df.columns:
                df = fill_column(
                    df, column, settings["fillna_method"], order=order,
                    max_rows=settings["max_series_rows"],
                )
                steps.append(f"filled {column} by {settings['fillna_method']}")
    if settings["remove_outdoor2"]:
        for pattern in settings["drop_patterns"]:
            width = len(df.columns)
            df = drop_columns_like(df, pattern)
            if len(df.columns) < width:
                steps.append(f"dropped columns with {pattern}")

    channels = discover_channels(df)
    steps.append(f"found {len(channels.names)} channels")
    raw_columns = df.columns
    sets["spend_features"] += channels.cost_columns
    sets["impression_features"] += channels.impression_columns

    counts: dict[str, dict[Level | None, int]] = {}
    effects = [c for c in ("geo", "week") if c in df.columns]
    form = settings["fixed_effects_form"]
    if form not in ("columns", "vector"):
        raise ValueError(f"unknown fixed_effects_form {form!r}: use 'columns' or 'vector'")
    as_vector = settings["create_fixed_effects"] and form == "vector" and bool(effects)
    if settings["create_fixed_effects"] and effects and not as_vector:
        counts = level_counts(df, effects)

    derived = cpm_columns(channels)
    if derived:
        steps.append("added cost per mille")
    if settings["log_transform"]:
        logged = log_columns(channels.cost_columns)
        sets["spend_features_log"] += logged
        derived.update({**logged, **log_columns(channels.impression_columns)})
        steps.append("added logarithms")
    late: list[str] = []
    if settings["handle_promotions"] and PROMO in df.columns:
        derived.update(promo_columns())
        late += ["promo_intensity"] if keyed else []
        made = [c for c in promo_feature_names() if c in derived or c in late]
        sets["promotional_features"] += made
        steps.append(f"added {len(made)} promotion features")
    else:
        sets["promotional_features"].append("has_promotion")
    organic = ORGANIC in df.columns
    df = df.withColumns({**derived, **({"log_organic": log_plus_one(ORGANIC)} if organic else {})})

    lags = lag_names(channels.cost_columns, settings["lag_periods"])
    lagged = settings["create_lags"] and keyed
    # No week of a geo has more rows than the geo: one bound serves both windows, and
    # both run on one partitioning by geo.
    longest = max(counts["geo"].values(), default=0) if "geo" in counts else None
    if longest is None and (lagged or late):
        longest = largest_group(df, ["geo"])
    if late:
        df = promo_intensity(df, max_rows=settings["max_series_rows"], largest=longest)
    if lagged:
        series = as_series(
            df, order=order, max_rows=settings["max_series_rows"], longest=longest
        )
        wanted = {**lags, **({"log_organic_lag1": ("log_organic", 1)} if organic else {})}
        df = lag_columns(series, wanted).result()
        late += lags
        sets["lagged_spend_features"] += wanted
        steps.append(f"added lags {list(settings['lag_periods'])}")

    encoded: dict[str, str] = {}
    if as_vector:
        df = add_sparse_effects(df, effects)
        late.append("fixed_effects")
        steps.append(f"added the fixed effects of {', '.join(effects)} as a vector")
    elif settings["create_fixed_effects"]:
        if "geo" in counts:
            sets["geo_fixed_effects"] += (of_geo := geo_dummies(sorted_levels(counts["geo"])))
            encoded.update(of_geo)
        if "week" in counts:
            sets["week_fixed_effects"] += (of_week := week_dummies(sorted_levels(counts["week"])))
            encoded.update(of_week)
        steps.append(f"added {len(encoded)} fixed effects")
    if settings["create_seasonality"] and "week" in raw_columns:
        weeks = (
            sorted_levels(counts["week"])
            if "week" in counts
            else distinct_levels(df, ["week"])["week"]
        )
        seasonal = calendar_dummies(weeks)
        encoded.update(seasonal)
        sets["seasonal_features"] += seasonal
        steps.append(f"added {len(seasonal)} seasonal dummies")

    tail = ["log_organic"] if organic else []
    if organic and lagged:
        tail.append("log_organic_lag1")
    sets["control_vars"] += tail
    df = df.selectExpr(
        *[sql.name(c) for c in [*raw_columns, *derived, *late]],
        *[sql.named(expression, name) for name, expression in encoded.items()],
        *tail,
    )
    sets["all_features"] += numeric_features(df)
    return Prepared(df, channels, sets, steps)


def preprocess_summary(prepared: Prepared) -> DataFrame:
    """Shape, channels, nulls and completeness of the feature table, in one pass."""
    df, channels = prepared.df, prepared.channels
    gaps = [f"(count(*) - count({sql.name(c)}))" for c in nullable_columns(df)]
    nulls = F.expr(sql.total(gaps)) if gaps else F.lit(0).cast("long")
    cells = F.count(F.lit(1)) * F.lit(len(df.columns))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(", ".join(channels.names)).alias("channels"),
        F.lit(len(channels.names)).cast("long").alias("n_channels"),
        F.lit(len(channels.cost_columns)).cast("long").alias("cost_columns"),
        F.lit(len(channels.impression_columns)).cast("long").alias("impression_columns"),
        nulls.alias("missing_values"),
        F.round((F.lit(1.0) - F.try_divide(nulls, cells)) * 100, 1).alias("completeness_pct"),
        F.lit(len(prepared.steps)).cast("long").alias("n_steps"),
    )


def nullable_columns(df: DataFrame) -> Sequence[str]:
    """Columns that may hold a null; dummies and flags cannot."""
    return [f.name for f in df.schema.fields if f.nullable]
