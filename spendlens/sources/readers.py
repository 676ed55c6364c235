"""Scans: files, catalog tables, and the import of a marketing panel."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators.joins import join_promotions

log = logging.getLogger(__name__)

# Columns whose lower-cased name holds one of these become numbers.
NUMERIC_NAME_PARTS = ["cost", "revenue", "conversion"]

# Names of the two tables of a dataset.
PANEL_TABLE = "cost_revenue"
PROMOTIONS_TABLE = "promotions"

# Plain decimal notation; Spark alone would also read Java suffixes such as "1d".
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"

_MISSING_CONDITIONS = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Read CSV with a header. Give a schema: inferring one costs a second scan.

    ``multiline`` reads quoted line breaks, at the price of unsplittable files.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    reader = reader.option("multiLine", multiline)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_table(
    spark: SparkSession, name_or_path: str, format: str | None = None, **options: str
) -> DataFrame:
    """Read a catalog table, or a path in ``format`` (any installed connector)."""
    if format is not None:
        return spark.read.format(format).options(**options).load(name_or_path)
    if "/" in name_or_path:
        return spark.read.options(**options).parquet(name_or_path)
    return spark.read.options(**options).table(name_or_path)


def read_optional_table(
    spark: SparkSession, name_or_path: str | None, format: str | None = None, **options: str
) -> DataFrame | None:
    """Like :func:`read_table`, or None with a warning when there is no such table.

    Spark resolves tables and paths when the reader is built, so a missing source
    shows here and not in a later job. Other failures are raised.
    """
    if name_or_path is None:
        return None
    try:
        return read_table(spark, name_or_path, format, **options)
    except AnalysisException as error:
        if error.getCondition() not in _MISSING_CONDITIONS:
            raise
        log.warning("table %s is not there; going on without it", name_or_path)
        return None


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL, which is what aggregates and null checks look at."""
    kinds = (T.DoubleType, T.FloatType)
    clean = {
        f.name: F.nullif(F.col(f"`{f.name}`"), F.lit(float("nan")))
        for f in df.schema.fields
        if isinstance(f.dataType, kinds)
    }
    return df.withColumns(clean) if clean else df


def to_number(column: Column) -> Column:
    """Text to double; what is not a number becomes null."""
    return F.when(column.rlike(_NUMBER), column.try_cast("double"))


def coerce_numeric(df: DataFrame, name_parts: list[str] | None = None) -> DataFrame:
    """Turn text columns with a cost, revenue or conversion name into doubles."""
    parts = name_parts or NUMERIC_NAME_PARTS
    casts = {
        f.name: to_number(F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and any(p in f.name.lower() for p in parts)
    }
    return df.withColumns(casts) if casts else df


def parse_week(df: DataFrame, column: str = "week", format: str | None = None) -> DataFrame:
    """Make the week a date. A bad value fails the job, whatever the ANSI setting."""
    if isinstance(df.schema[column].dataType, T.DateType):
        return df
    given = F.col(column)
    parsed = F.try_to_date(given, format)
    unreadable = F.raise_error(F.concat(F.lit(f"not a date in {column}: "), given.cast("string")))
    return df.withColumn(
        column, F.when(given.isNotNull() & parsed.isNull(), unreadable).otherwise(parsed)
    )


def import_panel(
    spark: SparkSession,
    source: str = "local",
    path: str | None = None,
    schema: T.StructType | str | None = None,
    table: str | None = None,
    promotions: str | None = None,
    dataset: str | None = None,
    format: str | None = None,
    gcp_project: str | None = None,
    gcp_dataset: str | None = None,
    **options: str,
) -> DataFrame:
    """Load the panel from a CSV file (``local``) or from tables (``warehouse``).

    The warehouse form joins the optional promotions table and makes numbers of
    text columns. A ``dataset`` names the schema that holds both tables under their
    usual names; ``gcp_dataset``, with the project it is in, is another word for it.
    Both forms give NULL for NaN; the week stays as it is stored.
    """
    if source == "local":
        if path is None:
            raise ValueError("a local import needs a path")
        return nan_to_null(read_csv(spark, path, schema))
    if source not in ("warehouse", "gcp"):
        raise ValueError(f"unknown source {source!r}: use 'local' or 'warehouse'")
    if dataset is None and gcp_dataset is not None:
        dataset = f"{gcp_project}.{gcp_dataset}" if gcp_project else gcp_dataset
    if dataset is not None:
        table = table or f"{dataset}.{PANEL_TABLE}"
        promotions = promotions or f"{dataset}.{PROMOTIONS_TABLE}"
    if table is None:
        raise ValueError("a warehouse import needs a table or a dataset")
    panel = read_table(spark, table, format, **options)
    promos = read_optional_table(spark, promotions, format, **options)
    if promos is not None:
        panel = join_promotions(panel, promos)
    return nan_to_null(coerce_numeric(panel))


def import_metadata(df: DataFrame, week: str = "week") -> DataFrame:
    """Row and column counts, and the first and last week as text."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.min(week).cast("string").alias("week_start"),
        F.max(week).cast("string").alias("week_end"),
    )
