"""The data report: quality, channels, promotions and column statistics.

Each report is one aggregation over the panel, combined on the map side; what leaves
the job is one row per column, channel, category or geo.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions import sql_text as sql
from spendlens.functions.columns import shorten
from spendlens.functions.promo_text import (
    KEYWORD_CATEGORIES,
    PROMO_TYPE_PATTERNS,
    matches_any,
    promo_flags_sql,
)
from spendlens.operators.channels import Channels, discover_channels
from spendlens.operators.quantiles import column_stats, exact_quantiles
from spendlens.operators.tables import small_table

PROMO = "promo_description"


@dataclass(frozen=True)
class _Report:
    """A table made of aggregates: one struct (SQL text) per row, then filter and order."""

    rows: list[str]
    schema: str
    order: tuple[str | Column, ...] = ()
    keep: Column | None = None

    def table(self, df: DataFrame) -> DataFrame:
        """All rows from one aggregation over ``df``."""
        if not self.rows:
            return small_table(df.sparkSession, [], self.schema)
        found = df.selectExpr(self.aggregate("_rows")).selectExpr("inline(_rows)")
        return self.finish(found)

    def aggregate(self, name: str) -> str:
        return sql.named(f"array({', '.join(self.rows)})", name)

    def finish(self, found: DataFrame) -> DataFrame:
        found = found if self.keep is None else found.where(self.keep)
        return found.orderBy(*self.order) if self.order else found


def report_channels(df: DataFrame) -> Channels:
    """Channels of the report: the name must hold ``cost_``, as written."""
    found = discover_channels(df)
    costs = [c for c in found.cost_columns if "cost_" in c]
    return Channels(
        [c.replace("cost_", "") for c in costs],
        costs,
        [c for c in found.impression_columns if "impression_" in c],
    )


def data_quality(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.min("week").cast("string").alias("week_start"),
        F.max("week").cast("string").alias("week_end"),
        F.countDistinct("geo").alias("n_geos"),
    )


def _missing(df: DataFrame) -> _Report:
    rows = []
    for c in df.columns:
        missing = f"(count(*) - count({sql.name(c)}))"
        rows.append(
            sql.struct(
                column_name=sql.literal(c),
                missing_count=missing,
                missing_pct=f"round(try_divide({missing} * 100D, count(*)), 2)",
            )
        )
    return _Report(
        rows,
        "column_name string, missing_count long, missing_pct double",
        (F.desc("missing_count"), "column_name"),
        F.col("missing_count") > 0,
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Null count and percentage of every column that has nulls, most first."""
    return _missing(df).table(df)


def _spend(df: DataFrame) -> _Report:
    channels = report_channels(df)
    rows = [
        sql.struct(
            channel=sql.literal(name),
            total_spend=f"coalesce(sum({sql.name(c)}), 0D)",
            avg_spend=f"avg({sql.name(c)})",
            min_spend=f"CAST(min({sql.name(c)}) AS DOUBLE)",
            max_spend=f"CAST(max({sql.name(c)}) AS DOUBLE)",
        )
        for name, c in zip(channels.names, channels.cost_columns)
    ]
    schema = (
        "channel string, total_spend double, avg_spend double, "
        "min_spend double, max_spend double"
    )
    return _Report(rows, schema, (F.desc("total_spend"), "channel"))


def spend_summary(df: DataFrame) -> DataFrame:
    """Total, mean, least and most spend per channel, largest total first."""
    return _spend(df).table(df)


def _impressions(df: DataFrame) -> _Report:
    rows = []
    for name in sorted(report_channels(df).names):
        seen = f"impression_{name}"
        if seen in df.columns:
            rows.append(
                sql.struct(
                    channel=sql.literal(name),
                    total_impressions=f"coalesce(sum({sql.name(seen)}), 0D)",
                    avg_impressions=f"avg({sql.name(seen)})",
                )
            )
    schema = "channel string, total_impressions double, avg_impressions double"
    return _Report(rows, schema, ("channel",))


def impression_summary(df: DataFrame) -> DataFrame:
    """Total and mean impressions of the channels that have a spend column."""
    return _impressions(df).table(df)


def _kpi(df: DataFrame) -> _Report:
    fields: dict[str, str] = {}
    schema: list[str] = []
    if "revenue" in df.columns:
        for name, f in (("total", "sum"), ("avg", "avg"), ("min", "min"), ("max", "max")):
            fields[f"{name}_revenue"] = f"CAST({f}(revenue) AS DOUBLE)"
            schema.append(f"{name}_revenue double")
    if "conversions" in df.columns:
        whole = isinstance(df.schema["conversions"].dataType, T.IntegralType)
        kind = "long" if whole else "double"
        fields["total_conversions"] = f"CAST(sum(conversions) AS {kind})"
        fields["avg_conversions"] = "CAST(avg(conversions) AS DOUBLE)"
        schema += [f"total_conversions {kind}", "avg_conversions double"]
    return _Report([sql.struct(**fields)] if fields else [], ", ".join(schema))


def kpi_summary(df: DataFrame) -> DataFrame:
    """Revenue and conversion totals, of whichever of the two columns there is."""
    report = _kpi(df)
    if not report.rows:
        raise ValueError("the data has neither revenue nor conversions")
    return report.table(df)


def promo_coverage(df: DataFrame, column: str = PROMO) -> DataFrame:
    """Rows with and without a promotion, and the number of different texts."""
    total, with_promo = F.count(F.lit(1)), F.count(column)
    return df.agg(
        total.alias("total_rows"),
        with_promo.alias("promo_rows"),
        (total - with_promo).alias("no_promo_rows"),
        F.try_divide(with_promo * F.lit(100.0), total).alias("promo_pct"),
        F.countDistinct(column).alias("distinct_promos"),
    )


def _keywords(column: str, categories: dict[str, list[str]] | None) -> _Report:
    text = sql.name(column)
    rows = []
    for name, patterns in (categories or KEYWORD_CATEGORIES).items():
        n = f"count_if({matches_any(text, patterns)})"
        rows.append(
            sql.struct(
                category=sql.literal(name),
                n_promos=n,
                promo_pct=f"try_divide({n} * 100D, count({text}))",
            )
        )
    return _Report(
        rows,
        "category string, n_promos long, promo_pct double",
        (F.desc("n_promos"), "category"),
        F.col("n_promos") > 0,
    )


def promo_keywords(
    df: DataFrame,
    column: str = PROMO,
    categories: dict[str, list[str]] | None = None,
) -> DataFrame:
    """How many promotion texts fall in each keyword category; empty ones left out."""
    return _keywords(column, categories).table(df)


def promo_by_geo(df: DataFrame, column: str = PROMO) -> DataFrame:
    """Rows with a promotion, all rows and the share, per geo (null geo left out)."""
    with_promo, total = F.count(column), F.count(F.lit(1))
    return (
        df.where(F.col("geo").isNotNull())
        .groupBy("geo")
        .agg(
            with_promo.alias("promo_rows"),
            total.alias("total_rows"),
            (with_promo * F.lit(100.0) / total).alias("promo_pct"),
        )
    )


def promo_samples(df: DataFrame, column: str = PROMO, n: int = 5, length: int = 65) -> DataFrame:
    """The first ``n`` promotion texts by week and geo, long ones shortened."""
    return (
        df.where(F.col(column).isNotNull())
        .orderBy("week", "geo", column)
        .select("week", "geo", shorten(column, length).alias("sample"))
        .limit(n)
    )


def _flag_counts(column: str, patterns: dict[str, list[str]] | None) -> _Report:
    rows = [
        sql.struct(
            promo_type=sql.literal(name),
            n_rows=f"coalesce(sum({flag}), 0L)",
            row_pct=f"try_divide(sum({flag}) * 100D, count(*))",
        )
        for name, flag in promo_flags_sql(column, patterns or PROMO_TYPE_PATTERNS).items()
    ]
    return _Report(
        rows,
        "promo_type string, n_rows long, row_pct double",
        (F.desc("n_rows"), "promo_type"),
    )


def promo_flag_counts(
    df: DataFrame, column: str = PROMO, patterns: dict[str, list[str]] | None = None
) -> DataFrame:
    """Rows per promotion type and their share of all rows."""
    return _flag_counts(column, patterns).table(df)


def describe_numeric(df: DataFrame, decimals: int | None = 2) -> DataFrame:
    """Count, mean, deviation (n-1), extremes and exact quartiles per numeric column.

    NaN counts as missing. Infinities are values: they sort to the ends, and make the mean
    infinite and the deviation NaN.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    stats = column_stats(df, numeric)
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75], stats=stats)
    rows = [
        (c, s.rows, s.mean, s.std, s.low, *quartiles[c], s.high) for c, s in stats.items()
    ]
    measures = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    schema = "column_name string, n_values long, " + ", ".join(f"{m} double" for m in measures)
    table = small_table(df.sparkSession, rows, schema)
    if decimals is None:
        return table
    return table.withColumns({m: F.round(m, decimals) for m in measures})


def data_report(df: DataFrame) -> dict[str, DataFrame]:
    """All reports by name.

    Those made of plain aggregates share one pass and hold its few rows; the others
    (distinct counts, per geo, samples, quartiles) read ``df`` on their own, so persist
    it first if it is costly to read.
    """
    shared = {
        "missing": _missing(df),
        "spend": _spend(df),
        "impressions": _impressions(df),
        "kpi": _kpi(df),
    }
    if PROMO in df.columns:
        shared["promo_keywords"] = _keywords(PROMO, None)
        shared["promo_flags"] = _flag_counts(PROMO, None)
    shared = {name: report for name, report in shared.items() if report.rows}
    facts = df.selectExpr(*[r.aggregate(name) for name, r in shared.items()]).first()
    reports = {
        name: report.finish(small_table(df.sparkSession, facts[name], report.schema))
        for name, report in shared.items()
    }
    reports["data_quality"] = data_quality(df)
    reports["describe"] = describe_numeric(df)
    if PROMO in df.columns:
        reports["promo_coverage"] = promo_coverage(df)
        reports["promo_by_geo"] = promo_by_geo(df)
        reports["promo_samples"] = promo_samples(df)
    return reports
