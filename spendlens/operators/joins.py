"""Left joins of a panel with promotions or another table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join in which a null key matches a null key; many matches fan out.

    It is written as the matches plus the left rows without one. In an inner join adaptive
    execution can split a crowded key of either side (in a left join only the left's), and no
    side is hinted: the right one is broadcast when its measured size allows.
    """
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    if shared:
        raise ValueError(f"both sides have columns besides the keys: {', '.join(shared)}")
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    )
    extra = [c for c in right.columns if c not in keys]
    matched = left.join(renamed, same, "inner").select(*left.columns, *extra)
    right_keys = renamed.select(*[f"_right_{k}" for k in keys]).distinct()
    unmatched = left.join(right_keys, same, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def join_common_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column both sides have; the left side as it is if none."""
    keys = sorted(set(left.columns) & set(right.columns))
    return left_join_null_safe(left, right, keys) if keys else left


def join_promotions(
    panel: DataFrame, promotions: DataFrame, keys: Sequence[str] = ("week", "geo")
) -> DataFrame:
    """Left join on (week, geo), or on all common columns when one of them is missing."""
    if all(k in panel.columns and k in promotions.columns for k in keys):
        return left_join_null_safe(panel, promotions, list(keys))
    return join_common_columns(panel, promotions)
