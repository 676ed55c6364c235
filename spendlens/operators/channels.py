"""Media channels: found by column name, dropped by name or for lack of data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators.tables import small_table


def numeric_columns(df: DataFrame) -> list[str]:
    """Double and long columns: the types channels and features are looked up in."""
    kinds = (T.DoubleType, T.LongType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


@dataclass(frozen=True)
class Channels:
    """Names only; the data stays in the DataFrame."""

    names: list[str]
    cost_columns: list[str]
    impression_columns: list[str]


def after(name: str, prefix: str) -> str | None:
    """What follows ``prefix`` and an underscore at the start of a name, whatever its case."""
    head = f"{prefix}_"
    return name[len(head) :] if name.lower().startswith(head) and len(name) > len(head) else None


def discover_channels(
    df: DataFrame, cost: str = "cost", impression: str = "impression"
) -> Channels:
    """Numeric columns named ``cost_<channel>`` and ``impression_<channel>``.

    Only the start of a name counts: a channel may be called ``low_cost_air`` or ``logistics``.
    """
    of = {kind: {c: after(c, kind) for c in numeric_columns(df)} for kind in (cost, impression)}
    spent = {c: name for c, name in of[cost].items() if name}
    return Channels(
        names=list(spent.values()),
        cost_columns=list(spent),
        impression_columns=[c for c, name in of[impression].items() if name],
    )


def channel_table(df: DataFrame, channels: Channels | None = None) -> DataFrame:
    """One row per channel: its columns and how many rows have a value in them."""
    channels = channels or discover_channels(df)
    if not channels.names:
        return small_table(
            df.sparkSession,
            [],
            "channel string, cost_column string, impression_column string, "
            "cost_rows long, impression_rows long",
        )
    rows = []
    for name, cost in zip(channels.names, channels.cost_columns):
        seen = f"impression_{name}"
        seen = seen if seen in channels.impression_columns else None
        rows.append(
            F.struct(
                F.lit(name).alias("channel"),
                F.lit(cost).alias("cost_column"),
                F.lit(seen).cast("string").alias("impression_column"),
                F.count(cost).alias("cost_rows"),
                (F.count(seen) if seen else F.lit(0).cast("long")).alias("impression_rows"),
            )
        )
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def drop_columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """Drop every column whose name contains ``pattern``, whatever its case."""
    return df.drop(*[c for c in df.columns if pattern.lower() in c.lower()])


def empty_channels(df: DataFrame, channels: Channels | None = None) -> list[str]:
    """Channels with a cost or impression column that is null in every row."""
    channels = channels or discover_channels(df)
    pairs = {}
    for name, cost in zip(channels.names, channels.cost_columns):
        seen = f"impression_{name}"
        pairs[name] = [cost] + ([seen] if seen in channels.impression_columns else [])
    columns = [c for pair in pairs.values() for c in pair]
    if not columns:
        return []
    filled = df.agg(
        F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in columns]
    ).first()
    if filled["_all"] == 0:
        return []
    return [name for name, pair in pairs.items() if any(filled[c] == 0 for c in pair)]


def drop_empty_channels(df: DataFrame) -> DataFrame:
    """Drop the cost and impression columns of channels without any data."""
    empty = empty_channels(df)
    return df.drop(*[f"{kind}_{name}" for name in empty for kind in ("cost", "impression")])
