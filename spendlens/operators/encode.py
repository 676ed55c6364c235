"""Dummy columns of a category: one per level, the first level left out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions import sql_text as sql
from spendlens.session import shared_path

Level = str | int


def level_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[Level | None, int]]:
    """Rows per level (null included) of each column.

    Levels are text, or numbers where the column holds whole numbers. They become columns of
    the plan, so they are brought to the driver; for a category with more levels than
    a table can have columns, see :func:`add_sparse_effects`.
    """
    counts: dict[str, dict[Level | None, int]] = {}
    for c in columns:
        whole = isinstance(df.schema[c].dataType, T.IntegralType)
        level = F.col(c) if whole else F.col(c).cast("string")
        found = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()
        counts[c] = {r["level"]: r["rows"] for r in found}
    return counts


def sorted_levels(counts: dict[Level | None, int]) -> list[Level]:
    return sorted(level for level in counts if level is not None)


def distinct_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[Level]]:
    """Sorted non-null levels of each column."""
    found = level_counts(df, columns)
    return {c: sorted_levels(found[c]) for c in columns}


def dummies(value: str, levels: Sequence, prefix: str) -> dict[str, str]:
    """0/1 expressions (as SQL text) for all but the first of the sorted levels.

    A null value gives 0 in all of them.
    """
    return {
        f"{prefix}_{level}": f"CAST({value} <=> {sql.literal(level)} AS INT)"
        for level in levels[1:]
    }


def geo_dummies(levels: Sequence[Level], geo: str = "geo") -> dict[str, str]:
    return dummies(sql.name(geo), levels, "geo_fe")


def week_dummies(levels: Sequence[str], week: str = "week") -> dict[str, str]:
    dates = [dt.date.fromisoformat(level) for level in levels]
    return dummies(sql.name(week), dates, "week_fe")


def calendar_dummies(weeks: Sequence[str], week: str = "week") -> dict[str, str]:
    """Month, quarter and ISO-week dummies of the levels that occur in ``weeks``."""
    dates = [dt.date.fromisoformat(w) for w in weeks]
    column = sql.name(week)
    return {
        **dummies(f"month({column})", sorted({d.month for d in dates}), "month"),
        **dummies(
            f"quarter({column})", sorted({(d.month + 2) // 3 for d in dates}), "quarter"
        ),
        **dummies(
            f"weekofyear({column})",
            sorted({d.isocalendar().week for d in dates}),
            "week_of_year",
        ),
    }


def with_dummies(df: DataFrame, encoded: dict[str, str]) -> DataFrame:
    """Add all dummies in one select; chained additions would be analysed again each."""
    return df.selectExpr("*", *[sql.named(e, n) for n, e in encoded.items()])


def add_geo_fixed_effects(df: DataFrame) -> DataFrame:
    levels = distinct_levels(df, ["geo"])["geo"]
    return with_dummies(df, geo_dummies(levels))


def add_week_fixed_effects(df: DataFrame) -> DataFrame:
    levels = distinct_levels(df, ["week"])["week"]
    return with_dummies(df, week_dummies(levels))


def add_calendar_dummies(
    df: DataFrame,
    parts: Sequence[str] = ("month", "quarter", "week_of_year"),
) -> DataFrame:
    """Add the dummies of some or all calendar parts."""
    weeks = distinct_levels(df, ["week"])["week"]
    wanted = {
        column: expression
        for column, expression in calendar_dummies(weeks).items()
        if column.rpartition("_")[0] in parts
    }
    return with_dummies(df, wanted)


def level_index(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(level, place) of the sorted non-null levels, from 0, and their number.

    The distinct levels are range-partitioned and sorted, so a level's place is its place in its partition after
    the sizes of the partitions before. Only these sizes, one number a partition, reach the
    driver. The levels are written to the shared folder: reading them tells the size by which a join chooses.
    """
    spark = df.sparkSession
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct()
    ranged = levels.repartitionByRange("level").sortWithinPartitions("level")
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    path = shared_path(spark, "levels")
    ranged.select("level", F.spark_partition_id().alias("part"), local.alias("local")).write.parquet(path)
    stored = spark.read.schema(ranged.schema.add("part", T.IntegerType()).add("local", T.LongType())).parquet(path)
    sizes = dict(stored.groupBy("part").count().collect())
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in before or [0]]), F.col("part") + 1)
    return stored.select("level", (offset + F.col("local")).alias("place")), total


def add_sparse_effects(
    df: DataFrame, columns: Sequence[str] = ("geo", "week"), name: str = "fixed_effects"
) -> DataFrame:
    """All effects of the columns as one sparse 0/1 vector, for any number of levels.

    ``name`` is a struct of ``size``, ``indices`` and ``values``: the first level of each
    column is left out, the others follow in sorted order, one column's after the other's. A null has no
    entry.
    """
    places, offset = [], 0
    for number, c in enumerate(columns):
        index, total = level_index(df, c)
        index = index.withColumnsRenamed({"level": f"_level_{number}", "place": f"_place_{number}"})
        df = df.join(index, F.col(c) == F.col(f"_level_{number}"), "left")
        place = F.col(f"_place_{number}")
        places.append(F.when(place > 0, place - 1 + F.lit(offset)))
        offset += max(total - 1, 0)
    indices = F.array_compact(F.array(*places))
    vector = F.struct(
        F.lit(offset).cast("long").alias("size"),
        indices.alias("indices"),
        F.transform(indices, lambda _: F.lit(1.0)).alias("values"),
    )
    helpers = [f"_{part}_{i}" for i in range(len(columns)) for part in ("level", "place")]
    return df.withColumn(name, vector).drop(*helpers)
