"""Eager checks made before a plan is built, and bounds measured for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the data: {', '.join(missing)}")


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group: one count with map-side combine, one number back."""
    if not keys:
        return df.count()
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.agg(F.max("_rows")).first()[0] or 0


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when two rows share the key; row order would be undefined then."""
    biggest = largest_group(df, keys)
    if biggest > 1:
        raise ValueError(f"({', '.join(keys)}) is not unique: {biggest} rows share one key")
    return df
