"""Exact quantiles without gathering a column in one task.

``percentile`` and ``median`` keep every distinct value of a column in the memory of
one task. Here the wanted ranks are narrowed down instead. A sketch gives a first short
range around each rank, checked by exact counts. Each round then counts the rows of a
range in equal bins (at most ``BINS`` groups per range leave a map task) and keeps only
the bin that holds the rank, until few enough rows are left to sort.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions import sql_text as sql

BINS = 1024
MAX_SORTED_ROWS = 100_000
ACCURACY = 1_000  # of the sketch: its ranks are off by at most 1/ACCURACY of the rows


@dataclass(frozen=True)
class _Range:
    """Values of a column from ``low`` to ``high``, with ``below`` values under it."""

    column: str
    low: float
    high: float
    below: int
    rows: int


@dataclass(frozen=True)
class ColumnStats:
    """One pass worth of facts about a column; None where it has no values.

    NaN is no value. Infinities are values, sorted to the ends; ``least`` and ``most`` are
    the extremes of the others.
    """

    rows: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None
    least: float | None
    most: float | None
    below: int = 0  # values of minus infinity
    above: int = 0
    odd: bool = False  # holds a NaN or an infinity


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnStats]:
    """Count, mean, sample deviation and extremes of all columns in one aggregation.

    Spark holds NaN to be above every number, so the extremes tell which columns hold a NaN
    or an infinity; only those are read once more.
    """
    if not columns:
        return {}
    values = {c: f"CAST({sql.name(c)} AS DOUBLE)" for c in columns}
    wanted = [part for i, v in enumerate(values.values()) for part in _facts(v, i)]
    row = df.selectExpr(*wanted).first()
    parts = ("rows", "mean", "std", "low", "high", "low", "high")
    found = {c: ColumnStats(*[row[f"{p}_{i}"] for p in parts]) for i, c in enumerate(columns)}
    odd = [
        c for c, known in found.items()
        if not all(math.isfinite(end or 0.0) for end in (known.low, known.high))
    ]
    if not odd:
        return found
    wanted = []
    for i, c in enumerate(odd):
        value = f"nullif({values[c]}, double('NaN'))"
        finite = f"CASE WHEN abs({value}) < double('Infinity') THEN {value} END"
        wanted += [
            *_facts(value, i),
            f"min({finite}) AS least_{i}",
            f"max({finite}) AS most_{i}",
            f"count_if({value} = double('-Infinity')) AS below_{i}",
            f"count_if({value} = double('Infinity')) AS above_{i}",
        ]
    row = df.selectExpr(*wanted).first()
    parts = ("rows", "mean", "std", "low", "high", "least", "most", "below", "above")
    found.update(
        {c: ColumnStats(*[row[f"{p}_{i}"] for p in parts], odd=True) for i, c in enumerate(odd)}
    )
    return found


def _facts(value: str, number: int) -> list[str]:
    return [
        f"count({value}) AS rows_{number}",
        f"avg({value}) AS mean_{number}",
        f"stddev_samp({value}) AS std_{number}",
        f"min({value}) AS low_{number}",
        f"max({value}) AS high_{number}",
    ]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    fractions: Sequence[float],
    max_sorted_rows: int = MAX_SORTED_ROWS,
    stats: Mapping[str, ColumnStats] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, nulls and NaN skipped.

    The result has one list per column, in the order of ``fractions``; a column
    without values gives None. Infinities are the first and last values; a quantile
    between an infinity and a number is that infinity (NaN between both infinities).
    ``stats`` saves a pass if they are known.
    """
    stats = column_stats(df, columns) if stats is None else stats
    wanted: dict[_Range, set[int]] = {}
    ends: dict[tuple[str, int], float] = {}
    for c in columns:
        known = stats[c]
        if known.rows == 0:
            continue
        ranks = {r for f in fractions for r in _ranks(f, known.rows)}
        ends.update({(c, r): -math.inf for r in ranks if r < known.below})
        ends.update({(c, r): math.inf for r in ranks if r >= known.rows - known.above})
        ranks = {r for r in ranks if (c, r) not in ends}
        if ranks:
            finite = known.rows - known.below - known.above
            wanted[_Range(c, known.least, known.most, known.below, finite)] = ranks
    regular = {span: ranks for span, ranks in wanted.items() if not stats[span.column].odd}
    # NaN and infinities would mislead the sketch: other columns start from the whole range.
    closer = _bracketed(df, regular, max_sorted_rows)
    closer.update({span: ranks for span, ranks in wanted.items() if span not in regular})
    values = {**ends, **_select_ranks(df, closer, max_sorted_rows)}
    return {c: [_interpolate(values, c, f, stats[c].rows) for f in fractions] for c in columns}


def exact_median(df: DataFrame, column: str, **options: int) -> float | None:
    return exact_quantiles(df, [column], [0.5], **options)[column][0]


def _ranks(fraction: float, rows: int) -> tuple[int, int]:
    position = fraction * (rows - 1)
    return math.floor(position), math.ceil(position)


def _interpolate(
    values: Mapping[tuple[str, int], float], column: str, fraction: float, rows: int
) -> float | None:
    if rows == 0:
        return None
    low, high = _ranks(fraction, rows)
    a, b = values[column, low], values[column, high]
    if a == b:
        return a
    return a + (b - a) * (fraction * (rows - 1) - low)


def _bracketed(
    df: DataFrame, wanted: dict[_Range, set[int]], max_sorted_rows: int
) -> dict[_Range, set[int]]:
    """Close in on the ranks of long columns with a sketch, then count exactly.

    The sketch is only a guess at a short range around each rank. One more pass counts
    the rows below and inside it, so a wrong guess is seen and the whole range kept.
    """
    long = {s: r for s, r in wanted.items() if s.rows > max_sorted_rows and s.low < s.high}
    if not long:
        return wanted
    places = [(span, rank) for span, ranks in long.items() for rank in sorted(ranks)]
    sketches = []
    for span, ranks in long.items():
        shares = [
            str(min(max(rank / (span.rows - 1) + side * 2 / ACCURACY, 0.0), 1.0))
            for rank in sorted(ranks)
            for side in (-1, 1)
        ]
        sketches.append(
            f"percentile_approx(CAST({sql.name(span.column)} AS DOUBLE), "
            f"array({', '.join(shares)}), {ACCURACY})"
        )
    guesses = [g for found in df.selectExpr(*sketches).first() for g in found]
    ends = list(zip(guesses[::2], guesses[1::2]))
    counts = []
    for (span, _), (low, high) in zip(places, ends):
        value = f"CAST({sql.name(span.column)} AS DOUBLE)"
        for upto in (f"< {sql.literal(low)}", f"<= {sql.literal(high)}"):
            counts.append(f"count_if({value} {upto})")
    counted = list(df.selectExpr(*[f"{c} AS n{i}" for i, c in enumerate(counts)]).first())
    closer: dict[_Range, set[int]] = {s: r for s, r in wanted.items() if s not in long}
    for i, ((span, rank), (low, high)) in enumerate(zip(places, ends)):
        below, upto = counted[2 * i], counted[2 * i + 1]
        if below <= rank < upto:
            span = _Range(span.column, low, high, below, upto - below)
        closer.setdefault(span, set()).add(rank)
    return closer


def _select_ranks(
    df: DataFrame, wanted: dict[_Range, set[int]], max_sorted_rows: int
) -> dict[tuple[str, int], float]:
    found: dict[tuple[str, int], float] = {}
    while wanted:
        wide: dict[_Range, set[int]] = {}
        short: dict[_Range, set[int]] = {}
        for span, ranks in wanted.items():
            if span.low == span.high:
                found.update({(span.column, r): span.low for r in ranks})
            elif span.rows <= max_sorted_rows:
                short[span] = ranks
            else:
                wide[span] = ranks
        if short:
            found.update(_sorted_ranks(df, short))
        wanted = _narrowed(df, wide) if wide else {}
    return found


def _in_ranges(df: DataFrame, spans: Sequence[_Range], binned: bool) -> DataFrame:
    """Rows (span, bin, value) of every span a value falls in; the rest goes early."""
    hits = []
    for number, span in enumerate(spans):
        value = f"CAST({sql.name(span.column)} AS DOUBLE)"
        low, high = sql.literal(span.low), sql.literal(span.high)
        # Halved where the width itself would overflow.
        part = "" if math.isfinite(span.high - span.low) else " / 2"
        share = f"({value}{part} - {low}{part}) / ({high}{part} - {low}{part})"
        place = f"CAST(least(floor({share} * {BINS}), {BINS - 1}) AS INT)" if binned else "0"
        hits.append(
            f"CASE WHEN {value} BETWEEN {low} AND {high} THEN "
            f"named_struct('span', {number}, 'bin', {place}, 'value', {value}) END"
        )
    return df.selectExpr(f"inline(array_compact(array({', '.join(hits)})))")


def _sorted_ranks(
    df: DataFrame, spans: Mapping[_Range, set[int]]
) -> dict[tuple[str, int], float]:
    """Pick the ranks out of ranges proven to hold few rows."""
    order = list(spans)
    places = {
        number: ", ".join(str(r - span.below + 1) for r in sorted(spans[span]))
        for number, span in enumerate(order)
    }
    cases = " ".join(f"WHEN {number} THEN array({p})" for number, p in places.items())
    rows = (
        _in_ranges(df, order, binned=False)
        .groupBy("span")
        .agg(F.sort_array(F.collect_list("value")).alias("values"))
        .selectExpr(
            "span", f"transform(CASE span {cases} END, p -> element_at(values, p)) AS picked"
        )
        .collect()
    )
    found = {}
    for row in rows:
        span = order[row["span"]]
        for rank, value in zip(sorted(spans[span]), row["picked"]):
            found[span.column, rank] = value
    return found


def _narrowed(df: DataFrame, spans: Mapping[_Range, set[int]]) -> dict[_Range, set[int]]:
    """Replace each range by the bins that hold its wanted ranks.

    Bin borders are the smallest and largest value found in a bin, so no rounding of
    the bin number can lose a value. The ends of a range fall in different bins,
    hence every round makes it smaller.
    """
    order = list(spans)
    bins = (
        _in_ranges(df, order, binned=True)
        .groupBy("span", "bin")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .collect()
    )
    narrowed: dict[_Range, set[int]] = {}
    for number, span in enumerate(order):
        below = span.below
        mine = sorted((b for b in bins if b["span"] == number), key=lambda b: b["bin"])
        for b in mine:
            inside = {r for r in spans[span] if below <= r < below + b["rows"]}
            if inside:
                narrowed[_Range(span.column, b["low"], b["high"], below, b["rows"])] = inside
            below += b["rows"]
    return narrowed
