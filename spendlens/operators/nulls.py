"""Missing values: constant, median and directional fills, complete rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.operators.checks import require_columns
from spendlens.operators.quantiles import exact_median
from spendlens.operators.series import MAX_SERIES_ROWS, as_series, fill_directional


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace nulls of the numeric columns (or of ``columns``) by 0."""
    return df.na.fill(0, list(columns) if columns is not None else None)


def median_fill(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """Replace nulls by the median of the whole column.

    Exact by default; an ``accuracy`` uses Spark's bounded-memory sketch in one pass,
    with a rank error of 1/accuracy.
    """
    require_columns(df, [column])
    if accuracy is None:
        median = exact_median(df, column)
    else:
        median = df.agg(F.percentile_approx(column, 0.5, accuracy)).first()[0]
    if median is None:
        return df
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(float(median))))


def fill_column(
    df: DataFrame,
    column: str,
    method: str = "median",
    keys: Sequence[str] = ("geo",),
    order: Sequence[str] = ("week",),
    max_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Fill one column by ``median``, or along its series by ``ffill`` or ``bfill``."""
    if method == "median":
        return median_fill(df, column)
    if method not in ("ffill", "bfill"):
        raise ValueError(f"unknown fill method {method!r}: use 'median', 'ffill' or 'bfill'")
    series = as_series(df, keys, order, max_rows)
    return fill_directional(series, [column], method).result()


def model_dataset(
    df: DataFrame,
    sales_column: str,
    spend_columns: Sequence[str],
    additional_features: Sequence[str] = (),
) -> DataFrame:
    """The features and the target, only rows in which none of them is null."""
    features = [*spend_columns, *additional_features]
    require_columns(df, [*features, sales_column])
    return df.select(*dict.fromkeys([*features, sales_column])).dropna("any")
