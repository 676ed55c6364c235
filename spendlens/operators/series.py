"""Operators along a time series per geo: lags, directional fills, carry-over.

A window partitioned by geo puts one geo into one task, which is right for weekly
series and wrong for a geo that holds a large share of all rows. ``as_series``
therefore measures the biggest geo first. Up to ``max_rows`` the plain window is used.
Beyond it, the rows are range-partitioned by (geo, order), so that a long series is
cut into consecutive segments in many tasks; each operator then works per segment
and carries a bounded summary per segment (its last k values, last known value, or
end level) into the next one. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from spendlens.operators.checks import largest_group, require_columns
from spendlens.session import shared_root

MAX_SERIES_ROWS = 2_000_000

_SEGMENT = "_segment"
_TIE = "_tie"


@dataclass(frozen=True)
class Series:
    """Rows with their series keys and order, cut into segments or not."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    longest: int
    segmented: bool

    @property
    def group(self) -> list[str]:
        return [*self.keys, _SEGMENT] if self.segmented else list(self.keys)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def with_df(self, df: DataFrame) -> Series:
        """The same layout for a DataFrame derived row by row from this one."""
        return Series(df, self.keys, self.order, self.longest, self.segmented)

    def result(self) -> DataFrame:
        return self.df.drop(_SEGMENT, _TIE)


def as_series(
    df: DataFrame,
    keys: Sequence[str] = ("geo",),
    order: Sequence[str] = ("week",),
    max_rows: int = MAX_SERIES_ROWS,
    longest: int | None = None,
) -> Series:
    """Decide how to lay out ``df`` as series of ``keys`` ordered by ``order``.

    Rows with equal ``order`` values come in any sequence: add a tie-breaking column to
    ``order``, or see ``assert_unique_key``. ``longest`` is the length of the longest
    series if the caller knows it; else it is counted.
    """
    require_columns(df, [*keys, *order])
    total = None
    if longest is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        counted = sizes.agg(F.max("_rows").alias("longest"), F.sum("_rows").alias("total")).first()
        longest, total = counted["longest"] or 0, counted["total"] or 0
    if longest <= max_rows:
        return Series(df, tuple(keys), tuple(order), longest, False)
    total = df.count() if total is None else total
    shared_root(df.sparkSession)
    order = tuple(order)
    if largest_group(df, [*keys, *order]) > max_rows:
        # Rows at one place of the order can only be cut apart by numbering them. Read
        # back from the checkpoint they come in a fixed sequence, so a lost task that
        # runs again gives them the same numbers.
        df = df.checkpoint(eager=True).withColumn(_TIE, F.monotonically_increasing_id())
        order = (*order, _TIE)
    # Range bounds come from a sample of the rows, so the cut is written down once.
    cut = (
        df.repartitionByRange(max(2, 2 * ceil(total / max_rows)), *keys, *order)
        .withColumn(_SEGMENT, F.spark_partition_id())
        .checkpoint(eager=True)
    )
    return Series(cut, tuple(keys), order, longest, True)


def _known_key(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def _join_carry(series: Series, df: DataFrame, carry: DataFrame) -> DataFrame:
    """Attach the per-segment carry columns; null keys match."""
    renamed = carry.withColumnsRenamed({k: f"_of_{k}" for k in series.group})
    same = F.lit(True)
    for key in series.group:
        same = same & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    return df.join(renamed, same, "left").drop(*[f"_of_{k}" for k in series.group])


def lag_columns(
    series: Series,
    lags: Mapping[str, tuple[str, int]],
    fill: float | None = 0.0,
) -> Series:
    """Add lagged columns: ``{new name: (column, k)}``.

    Lags count rows, not weeks. A missing value, the start of a series and a row
    without a key all give ``fill``.
    """
    if any(k < 1 for _, k in lags.values()):
        raise ValueError("lags go back at least one row")
    if not lags:
        return series
    plain = {name: F.lag(c, k).over(series.window) for name, (c, k) in lags.items()}
    if series.segmented:
        df = _lag_across_segments(series, lags, plain)
        plain = {name: F.col(f"_local_{name}") for name in lags}
    else:
        df = series.df
    known = _known_key(series.keys)
    finished = {}
    for name, value in plain.items():
        value = F.when(known, value)
        finished[name] = value if fill is None else F.coalesce(value, F.lit(fill))
    df = df.withColumns(finished)
    return series.with_df(df.drop(*[c for c in df.columns if c.startswith("_local_")]))


def _lag_across_segments(
    series: Series, lags: Mapping[str, tuple[str, int]], local: Mapping[str, Column]
) -> DataFrame:
    deepest = max(k for _, k in lags.values())
    columns = sorted({c for c, _ in lags.values()})
    size = F.count(F.lit(1)).over(Window.partitionBy(*series.group))
    numbered = series.df.withColumns(
        {"_row": F.row_number().over(series.window), "_size": size}
    )
    tail = (
        numbered.where(F.col("_row") > F.col("_size") - deepest)
        .groupBy(*series.group)
        .agg(F.sort_array(F.collect_list(F.struct("_row", *columns))).alias("_tail"))
    )
    # Every segment has a row, so the k segments before this one hold the last k rows.
    before = Window.partitionBy(*series.keys).orderBy(_SEGMENT).rowsBetween(-deepest, -1)
    carry = tail.select(
        *series.group, F.flatten(F.collect_list("_tail").over(before)).alias("_before")
    )
    joined = _join_carry(
        series,
        numbered.withColumns({f"_local_{name}": value for name, value in local.items()}),
        carry,
    )
    crossing = {}
    for name, (column, k) in lags.items():
        from_end = F.col("_row") - F.lit(k + 1)  # -1 is the last row before the segment
        previous = F.try_element_at(F.col("_before"), from_end.cast("int"))
        crossing[f"_local_{name}"] = F.when(
            F.col("_row") > k, F.col(f"_local_{name}")
        ).otherwise(F.when(from_end < 0, previous[column]))
    return joined.withColumns(crossing).drop("_row", "_size", "_before")


def fill_directional(
    series: Series, columns: Sequence[str], method: str = "ffill"
) -> Series:
    """Fill nulls from the row before (``ffill``) or after (``bfill``) in the series.

    What that leaves open at the start (or end) is filled from the other side.
    """
    if method not in ("ffill", "bfill"):
        raise ValueError(f"unknown fill method {method!r}: use 'ffill' or 'bfill'")
    back = series.window.rowsBetween(Window.unboundedPreceding, 0)
    ahead = series.window.rowsBetween(0, Window.unboundedFollowing)
    df = series.df
    if series.segmented:
        place = F.struct(*series.order)
        ends = df.groupBy(*series.group).agg(
            *[
                pick(c, F.when(F.col(c).isNotNull(), place)).alias(f"_{side}_{c}")
                for c in columns
                for side, pick in (("first", F.min_by), ("last", F.max_by))
            ]
        )
        segments = Window.partitionBy(*series.keys).orderBy(_SEGMENT)
        earlier = segments.rowsBetween(Window.unboundedPreceding, -1)
        later = segments.rowsBetween(1, Window.unboundedFollowing)
        carry = ends.select(
            *series.group,
            *[F.last(f"_last_{c}", True).over(earlier).alias(f"_earlier_{c}") for c in columns],
            *[F.first(f"_first_{c}", True).over(later).alias(f"_later_{c}") for c in columns],
        )
        df = _join_carry(series, df, carry)
    filled = {}
    for c in columns:
        forward = [F.last(c, True).over(back)]
        backward = [F.first(c, True).over(ahead)]
        if series.segmented:
            forward.append(F.col(f"_earlier_{c}"))
            backward.append(F.col(f"_later_{c}"))
        sides = forward + backward if method == "ffill" else backward + forward
        filled[c] = F.coalesce(F.col(c), *sides)
    df = df.withColumns(filled)
    carried = [f"_{side}_{c}" for c in columns for side in ("earlier", "later")]
    return series.with_df(df.drop(*carried))


def adstock(
    series: Series,
    decay: Mapping[str, float],
    suffix: str = "_adstocked",
    null_policy: str = "zero",
) -> Series:
    """Geometric carry-over a[t] = x[t] + d * a[t-1], one decay per column.

    Built by doubling: adding d^h times the value h rows earlier, for h = 1, 2, 4, ...,
    doubles the history covered each time, so a series of n rows needs log2(n) lag
    steps on one sort and stays in the JVM. Steps end early once d^h is zero in
    double precision.

    ``null_policy="zero"`` reads a null as no spend; ``"propagate"`` makes it and every
    later value of the series null.
    """
    if null_policy not in ("zero", "propagate"):
        raise ValueError(f"unknown null policy {null_policy!r}: use 'zero' or 'propagate'")
    for column, rate in decay.items():
        if not 0 <= rate <= 1:
            raise ValueError(f"decay of {column} must be between 0 and 1, not {rate}")
    require_columns(series.df, list(decay))
    level = {c: f"{c}{suffix}" for c in decay}
    running = series.window.rowsBetween(Window.unboundedPreceding, 0)
    df = series.df.withColumns({level[c]: F.coalesce(F.col(c), F.lit(0.0)) for c in decay})

    lasting = [c for c, rate in decay.items() if rate == 1]
    if lasting:
        df = df.withColumns({level[c]: F.sum(level[c]).over(running) for c in lasting})
    reach = 1
    while reach < series.longest:
        active = [c for c, rate in decay.items() if 0 < rate < 1 and rate**reach > 0]
        if not active:
            break
        df = df.withColumns(
            {
                level[c]: F.col(level[c])
                + F.lit(decay[c] ** reach)
                * F.lag(level[c], reach, 0.0).over(series.window)
                for c in active
            }
        )
        reach *= 2

    if series.segmented:
        df = _carry_levels(series, df, decay, level)
    if null_policy == "propagate":
        df = _spoil_after_null(series, df, level)
    return series.with_df(df)


def _carry_levels(
    series: Series, df: DataFrame, decay: Mapping[str, float], level: Mapping[str, str]
) -> DataFrame:
    """Add what is left of the level at the end of the segment before."""
    df = df.withColumn("_row", F.row_number().over(series.window))
    ends = df.groupBy(*series.group).agg(
        F.max("_row").cast("double").alias("_rows"),
        *[F.max_by(level[c], "_row").alias(f"_end_{c}") for c in decay],
    )
    # A segment takes what comes in times d^rows, and adds its own end level. Two neighbours together do the
    # same with the product of their factors: pairs of (factor, level) are merged by doubling.
    ends = ends.withColumns({f"_kept_{c}": F.pow(F.lit(float(d)), "_rows") for c, d in decay.items()})
    along = Window.partitionBy(*series.keys).orderBy(_SEGMENT)
    reach, most = 1, ends.groupBy(*series.keys).count().agg(F.max("count")).first()[0] or 0
    while reach < most:
        merged = {}
        for c in decay:
            before = F.lag(f"_end_{c}", reach, 0.0).over(along)
            merged[f"_end_{c}"] = F.col(f"_end_{c}") + F.col(f"_kept_{c}") * before
            merged[f"_kept_{c}"] = F.col(f"_kept_{c}") * F.lag(f"_kept_{c}", reach, 0.0).over(along)
        ends = ends.withColumns(merged)
        reach *= 2
    carry = ends.select(
        *series.group, *[F.lag(f"_end_{c}", 1, 0.0).over(along).alias(f"_before_{c}") for c in decay]
    )
    df = _join_carry(series, df, carry)
    df = df.withColumns(
        {
            level[c]: F.col(level[c])
            + F.pow(F.lit(float(decay[c])), F.col("_row")) * F.col(f"_before_{c}")
            for c in decay
        }
    )
    return df.drop("_row", *[f"_before_{c}" for c in decay])


def _spoil_after_null(series: Series, df: DataFrame, level: Mapping[str, str]) -> DataFrame:
    """Null the level from the first null of its column on."""
    running = series.window.rowsBetween(Window.unboundedPreceding, 0)
    spoiled = {c: F.max(F.col(c).isNull()).over(running) for c in level}
    if series.segmented:
        segments = df.groupBy(*series.group).agg(
            *[F.max(F.col(c).isNull()).alias(f"_null_{c}") for c in level]
        )
        earlier = (
            Window.partitionBy(*series.keys)
            .orderBy(_SEGMENT)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = segments.select(
            *series.group,
            *[F.max(f"_null_{c}").over(earlier).alias(f"_spoiled_{c}") for c in level],
        )
        df = _join_carry(series, df, carry)
        spoiled = {
            c: value | F.coalesce(F.col(f"_spoiled_{c}"), F.lit(False))
            for c, value in spoiled.items()
        }
    df = df.withColumns({level[c]: F.when(~spoiled[c], F.col(level[c])) for c in level})
    return df.drop(*[f"_spoiled_{c}" for c in level])


def adstock_channels(
    df: DataFrame,
    spend_columns: Sequence[str],
    decay_rates: Mapping[str, float] | None = None,
    default_decay: float = 0.5,
    keys: Sequence[str] = ("geo",),
    order: Sequence[str] = ("week",),
    max_rows: int = MAX_SERIES_ROWS,
    null_policy: str = "zero",
) -> DataFrame:
    """Adstock every spend column that exists, into ``<column>_adstocked``."""
    rates = decay_rates or {}
    decay = {c: rates.get(c, default_decay) for c in spend_columns if c in df.columns}
    if not decay:
        return df
    series = as_series(df, keys, order, max_rows)
    return adstock(series, decay, null_policy=null_policy).result()


def promo_intensity(
    df: DataFrame,
    column: str = "promo_description",
    keys: Sequence[str] = ("geo", "week"),
    name: str = "promo_intensity",
    max_rows: int = MAX_SERIES_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Number of active promotions (non-null texts) in the row's geo and week.

    ``largest`` bounds the rows of a key if the caller knows it; else it is counted.
    Small keys use a window, which reuses a partitioning by geo. A key above
    ``max_rows`` is counted first, with map-side combine, and the count joined back:
    adaptive execution can split the rows of a crowded key there. Rows with a null key
    get null.
    """
    if largest is None:
        largest = largest_group(df, keys)
    known = _known_key(keys)
    if largest <= max_rows:
        count = F.count(column).over(Window.partitionBy(*keys))
        return df.withColumn(name, F.when(known, count))
    counts = df.where(known).groupBy(*keys).agg(F.count(column).alias(name))
    return df.join(counts, list(keys), "left").select(*df.columns, name)
