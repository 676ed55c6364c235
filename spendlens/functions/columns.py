"""Column expressions for features. All run inside generated code on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(column: ColumnOrName) -> Column:
    return F.col(column) if isinstance(column, str) else column


def log_plus_one(column: ColumnOrName) -> Column:
    """ln(x + 1); null for null and for x <= -1."""
    return F.log1p(_col(column))


def cost_per_mille(cost: ColumnOrName, impressions: ColumnOrName) -> Column:
    """Cost per thousand impressions; the 1 added below guards against zero."""
    return F.try_divide(_col(cost), _col(impressions) / F.lit(1000.0) + F.lit(1.0))


def has_value(column: ColumnOrName) -> Column:
    return _col(column).isNotNull().cast("long")


def month_of(week: ColumnOrName) -> Column:
    return F.month(_col(week))


def quarter_of(week: ColumnOrName) -> Column:
    return F.quarter(_col(week))


def iso_week_of(week: ColumnOrName) -> Column:
    return F.weekofyear(_col(week))


def shorten(text: ColumnOrName, length: int = 65) -> Column:
    """The first ``length`` characters and an ellipsis, or the text if it is short."""
    text = _col(text)
    return F.when(
        F.char_length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def channel_of(feature: ColumnOrName) -> Column:
    """``cost_tv_log`` -> ``tv``: only the start and the end of the name are cut."""
    return F.regexp_replace(_col(feature), "^cost_|_log$", "")
