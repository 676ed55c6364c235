import numpy as np
import pytest

from spendlens.operators.nulls import fill_column, median_fill
from spendlens.operators.profile import describe_numeric
from spendlens.operators.quantiles import exact_quantiles

FRACTIONS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


CASES = {
    "even": [1, 2, 4, 10],
    "one": [5],
    "same": [3] * 50,
    "hot value": [0] * 400 + list(range(200)),
    "heavy tail": list(np.exp(np.linspace(-40, 40, 300))),
    "signs": list(np.linspace(-7, 7, 301)) + [None] * 20,
    "far apart": [-1.7e308, 0.0, 1.0, 2.0, 1.7e308],
    "tiny gaps": [1.0, float(np.nextafter(1.0, 2)), float(np.nextafter(1.0, 0)), 1.0, 1e300],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("max_sorted_rows", [0, 10, 100_000])
def test_quantiles_equal_numpy(spark, case, max_sorted_rows):
    values = [v for v in CASES[case] if v is not None]
    got = exact_quantiles(frame(spark, CASES[case]), ["x"], FRACTIONS, max_sorted_rows)["x"]
    ordered = sorted(float(v) for v in values)
    for fraction, found in zip(FRACTIONS, got):
        position = fraction * (len(ordered) - 1)
        low, high = ordered[int(np.floor(position))], ordered[int(np.ceil(position))]
        assert found == low + (high - low) * (position - np.floor(position))


def test_several_columns_at_once(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=500), rng.pareto(0.3, size=500)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    got = exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5], max_sorted_rows=7)
    assert got["a"] == pytest.approx(np.quantile(a, [0.25, 0.5]), rel=1e-14)
    assert got["b"] == pytest.approx(np.quantile(b, [0.25, 0.5]), rel=1e-14)
    assert got["c"] == [None, None]


INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("max_sorted_rows", [0, 10, 100_000])
def test_nan_is_missing_and_infinities_sort_to_the_ends(spark, max_sorted_rows):
    def quantiles(values, fractions):
        return exact_quantiles(frame(spark, values), ["x"], fractions, max_sorted_rows)["x"]

    many = [-INF] * 3 + list(range(20)) + [INF] * 2 + [NAN, None, NAN]
    assert quantiles(many, [0.0, 2 / 24, 3 / 24, 12 / 24, 22 / 24, 23 / 24, 1.0]) == [-INF, -INF, 0, 9, 19, INF, INF]
    assert quantiles([1, INF], [0.0, 0.5, 1.0]) == [1, INF, INF]
    assert quantiles([INF, INF], [0.5]) == [INF]
    assert quantiles([NAN, None], [0.5]) == [None]
    assert quantiles([NAN, 3, NAN, 5], [0.5]) == [4]
    assert np.isnan(quantiles([-INF, INF], [0.5])[0])


def test_describe_with_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0, NAN), (2.0, 1.0), (INF, 3.0)], "a double, b double")
    rows = {r["column_name"]: r for r in describe_numeric(df).collect()}
    assert (rows["a"]["n_values"], rows["a"]["mean"], rows["a"]["p50"], rows["a"]["max"]) == (3, INF, 2.0, INF)
    assert np.isnan(rows["a"]["std"])
    assert (rows["b"]["n_values"], rows["b"]["mean"], rows["b"]["p50"], rows["b"]["max"]) == (2, 2.0, 2.0, 3.0)


def test_median_fill(spark):
    df = frame(spark, [1, None, 2, 4, 10])
    assert sorted(r[0] for r in median_fill(df, "x").collect()) == [1, 2, 3, 4, 10]
    empty = frame(spark, [None, None])
    assert [r[0] for r in median_fill(empty, "x").collect()] == [None, None]
    close = median_fill(df, "x", accuracy=1000).collect()
    assert sorted(r[0] for r in close) == [1, 2, 2, 4, 10]


def test_fill_column_rejects_other_methods(spark):
    with pytest.raises(ValueError, match="unknown fill method"):
        fill_column(frame(spark, [1]), "x", "mean")


def test_describe(spark):
    df = spark.createDataFrame([(1, 1.0, "t"), (2, None, "u"), (4, 3.0, "v"), (10, 5.5, None)], "a long, b double, c string")
    rows = {r["column_name"]: r for r in describe_numeric(df).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["mean"], rows["a"]["std"], rows["a"]["p25"], rows["a"]["p50"], rows["a"]["p75"]) == (4.25, 4.03, 1.75, 3.0, 5.5)
    assert (rows["b"]["n_values"], rows["b"]["min"], rows["b"]["max"]) == (3, 1.0, 5.5)


def test_describe_of_no_rows(spark):
    df = spark.createDataFrame([], "a long, b double")
    rows = describe_numeric(df).collect()
    assert [(r["n_values"], r["mean"], r["p50"]) for r in rows] == [(0, None, None)] * 2
