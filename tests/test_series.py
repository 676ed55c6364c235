import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spendlens.operators.checks import assert_unique_key
from spendlens.operators.series import (
    adstock,
    adstock_channels,
    as_series,
    fill_directional,
    lag_columns,
    promo_intensity,
)

SCHEMA = "geo string, week date, x double, y double"


def monday(i):
    return dt.date(2022, 1, 3) + dt.timedelta(weeks=i)


def frame(spark, series, schema=SCHEMA):
    """{geo: [(x, y), ...]} in week order."""
    rows = [
        (geo, monday(i), x, y)
        for geo, values in series.items()
        for i, (x, y) in enumerate(values)
    ]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, schema)


def result(df, column):
    rows = sorted(df.collect(), key=lambda r: (r["geo"] or "", r["week"]))
    out = {}
    for r in rows:
        out.setdefault(r["geo"], []).append(r[column])
    return out


def pairs(*values):
    return [(v, None) for v in values]


# --- carry-over ---------------------------------------------------------------------


def brute_adstock(values, decay):
    level, out = 0.0, []
    for v in values:
        level = (v or 0.0) + decay * level
        out.append(level)
    return out


def test_adstock_of_the_definition(spark):
    df = frame(spark, {"a": pairs(10.0, 0.0, 5.0, 1.0), "b": pairs(3.0)})
    got = result(adstock(as_series(df), {"x": 0.5}).result(), "x_adstocked")
    assert got == {"a": [10.0, 5.0, 7.5, 4.75], "b": [3.0]}


@pytest.mark.parametrize("decay,expected", [(0.0, [1.0, 2.0, 3.0]), (1.0, [1.0, 3.0, 6.0])])
def test_adstock_at_the_ends(spark, decay, expected):
    df = frame(spark, {"a": pairs(1.0, 2.0, 3.0)})
    assert result(adstock(as_series(df), {"x": decay}).result(), "x_adstocked")["a"] == expected


@pytest.mark.parametrize("decay", [-0.1, 1.5])
def test_adstock_rejects_decay(spark, decay):
    df = frame(spark, {"a": pairs(1.0)})
    with pytest.raises(ValueError, match="between 0 and 1"):
        adstock(as_series(df), {"x": decay})


@pytest.mark.parametrize("max_rows", [1000, 2])
def test_adstock_null_policies(spark, max_rows):
    df = frame(spark, {"a": pairs(4.0, None, 2.0, 1.0, 0.0, 8.0), "b": pairs(1.0, 1.0)})
    series = as_series(df, max_rows=max_rows)
    zero = result(adstock(series, {"x": 0.5}).result(), "x_adstocked")
    assert zero == {"a": brute_adstock([4, 0, 2, 1, 0, 8], 0.5), "b": [1.0, 1.5]}
    spoiled = adstock(series, {"x": 0.0}, null_policy="propagate").result()
    assert result(spoiled, "x_adstocked") == {"a": [4.0] + [None] * 5, "b": [1.0, 1.0]}


def test_adstock_channels_skips_missing_columns_and_uses_the_default(spark):
    df = frame(spark, {"a": [(10.0, 1.0), (0.0, 1.0)]})
    got = adstock_channels(df, ["x", "y", "z"], {"y": 1.0})
    assert "z_adstocked" not in got.columns
    assert result(got, "x_adstocked")["a"] == [10.0, 5.0]
    assert result(got, "y_adstocked")["a"] == [1.0, 2.0]


def test_long_series_in_segments_matches_a_loop(spark):
    rng = random.Random(3)
    data = {
        "hot": [(rng.choice([0.0, rng.random() * 100]), None) for _ in range(900)],
        "cold": [(rng.random(), None) for _ in range(7)],
    }
    df = frame(spark, data)
    series = as_series(df, max_rows=60)
    assert series.segmented
    hot_segments = series.df.where("geo = 'hot'").select("_segment").distinct().count()
    assert hot_segments > 5
    got = result(adstock(series, {"x": 0.93}).result(), "x_adstocked")
    for geo, values in data.items():
        assert got[geo] == pytest.approx(brute_adstock([v for v, _ in values], 0.93), rel=1e-12)


number = st.one_of(st.none(), st.floats(0, 1e6, allow_nan=False))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.dictionaries(
        st.sampled_from(["a", "b", "c"]), st.lists(number, min_size=1, max_size=25), min_size=1
    ),
    st.floats(0, 1),
    st.sampled_from([1, 3, 100]),
)
def test_adstock_property(spark, data, decay, max_rows):
    df = frame(spark, {g: pairs(*v) for g, v in data.items()})
    got = result(adstock(as_series(df, max_rows=max_rows), {"x": decay}).result(), "x_adstocked")
    for geo, values in data.items():
        assert got[geo] == pytest.approx(brute_adstock(values, decay), rel=1e-9, abs=1e-9)


# --- lags ---------------------------------------------------------------------------


def brute_lag(values, k, fill):
    shifted = [None] * k + list(values[:-k] if k < len(values) else [])
    return [fill if v is None else v for v in shifted[: len(values)]]


def test_lag_fills_starts_and_null_spend_with_zero(spark):
    df = frame(spark, {"a": pairs(1.0, None, 3.0, 4.0), "b": pairs(9.0)})
    got = lag_columns(as_series(df), {"l1": ("x", 1), "l2": ("x", 2)}).result()
    assert result(got, "l1") == {"a": [0.0, 1.0, 0.0, 3.0], "b": [0.0]}
    assert result(got, "l2") == {"a": [0.0, 0.0, 1.0, 0.0], "b": [0.0]}


def test_lag_counts_rows_not_weeks(spark):
    rows = [("a", monday(0), 1.0, None), ("a", monday(5), 2.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lag_columns(as_series(df), {"l1": ("x", 1)}).result()
    assert result(got, "l1")["a"] == [0.0, 1.0]


@pytest.mark.parametrize("max_rows", [1000, 1])
def test_rows_without_geo_get_no_lag(spark, max_rows):
    df = frame(spark, {None: pairs(1.0, 2.0, 3.0), "a": pairs(4.0, 5.0)})
    got = lag_columns(as_series(df, max_rows=max_rows), {"l1": ("x", 1)}).result()
    assert result(got, "l1") == {None: [0.0, 0.0, 0.0], "a": [0.0, 4.0]}


@pytest.mark.parametrize("max_rows", [1, 4, 50])
def test_lags_across_segments(spark, max_rows):
    rng = random.Random(max_rows)
    data = {
        g: [(rng.choice([None, rng.random()]), rng.random()) for _ in range(n)]
        for g, n in {"a": 120, "b": 1, "c": 17}.items()
    }
    df = frame(spark, data)
    lags = {"x1": ("x", 1), "x3": ("x", 3), "y2": ("y", 2), "x9": ("x", 9)}
    got = lag_columns(as_series(df, max_rows=max_rows), lags).result()
    assert got.count() == 138
    for name, (column, k) in lags.items():
        found = result(got, name)
        for geo, values in data.items():
            assert found[geo] == brute_lag([v["xy".index(column)] for v in values], k, 0.0)


def test_crowded_week_is_cut_too(spark):
    """A third of the rows share geo and week, and are copies of each other."""
    copies = [("a", monday(3), 1.0, None)] * 200
    rest = [(g, monday(i), 1.0, None) for g in ("a", "b") for i in range(200) if (g, i) != ("a", 3)]
    df = spark.createDataFrame(copies + rest, SCHEMA)
    series = as_series(df, max_rows=50)
    crowded = series.df.where("geo = 'a' and week = '2022-01-24'")
    assert crowded.select("_segment").distinct().count() > 2
    got = adstock(lag_columns(series, {"l1": ("x", 1)}), {"x": 1.0}).result()
    assert got.columns == ["geo", "week", "x", "y", "l1", "x_adstocked"]
    for geo, n in (("a", 399), ("b", 200)):
        rows = got.where(f"geo = '{geo}'").collect()
        assert sorted(r["x_adstocked"] for r in rows) == [float(i + 1) for i in range(n)]
        assert sorted(r["l1"] for r in rows) == [0.0] + [1.0] * (n - 1)


def test_duplicate_keys_are_reported(spark):
    df = frame(spark, {"a": pairs(1.0, 2.0)})
    assert assert_unique_key(df, ["geo", "week"]) is df
    with pytest.raises(ValueError, match="not unique"):
        assert_unique_key(df.union(df), ["geo", "week"])


# --- fills --------------------------------------------------------------------------


def brute_fill(values, method):
    def forward(vs):
        last, out = None, []
        for v in vs:
            last = v if v is not None else last
            out.append(last)
        return out

    def backward(vs):
        return forward(vs[::-1])[::-1]

    first, second = (forward, backward) if method == "ffill" else (backward, forward)
    return second(first(values))


@pytest.mark.parametrize("method", ["ffill", "bfill"])
@pytest.mark.parametrize("max_rows", [1, 5, 1000])
def test_fills(spark, method, max_rows):
    rng = random.Random(5)
    data = {
        "a": [rng.choice([None, None, float(i)]) for i in range(60)],
        "b": [None, None, 2.0, None],
        "c": [None, None],
    }
    df = frame(spark, {g: pairs(*v) for g, v in data.items()})
    got = fill_directional(as_series(df, max_rows=max_rows), ["x"], method).result()
    assert result(got, "x") == {g: brute_fill(v, method) for g, v in data.items()}


def test_fill_rejects_other_methods(spark):
    with pytest.raises(ValueError, match="unknown fill method"):
        fill_directional(as_series(frame(spark, {"a": pairs(1.0)})), ["x"], "nearest")


# --- promotions per key ----------------------------------------------------------------


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_promo_intensity(spark, max_rows):
    rows = [("a", 1, "p"), ("a", 1, "q"), ("a", 1, None), ("a", 2, None), (None, 1, "r"), ("a", None, "s")]
    df = spark.createDataFrame(rows, "geo string, week int, promo_description string")
    got = promo_intensity(df, max_rows=max_rows)
    found = {(r["geo"], r["week"], r["promo_description"]): r["promo_intensity"] for r in got.collect()}
    assert found == {
        ("a", 1, "p"): 2, ("a", 1, "q"): 2, ("a", 1, None): 2, ("a", 2, None): 0,
        (None, 1, "r"): None, ("a", None, "s"): None,
    }
