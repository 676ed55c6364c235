import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from spendlens.operators.moments import regression_moments
from spendlens.operators.regression import (
    coefficient_table,
    compare_models,
    evaluate,
    fit,
    model_from_table,
    model_summary,
    model_table,
    predict,
    solve,
    standardize,
)


def table(spark, x, y, partitions=4):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [tuple(map(float, (*r, t))) for r, t in zip(x, y)]
    schema = ", ".join(f"{c} double" for c in [*names, "y"])
    return spark.createDataFrame(rows, schema).repartition(partitions), names


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 3))
    x = np.column_stack(
        [base[:, 0] * 40 + 1000, base[:, 0] + 0.5 * base[:, 1], base[:, 2] ** 2 * 1e-3]
    )
    y = 3 * x[:, 0] - 20 * x[:, 1] + 5e4 * x[:, 2] + rng.normal(size=300) * 30 + 77
    return x, y


def scaled(x, y):
    return (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()


def brute_lasso(x, y, alpha, rounds=20000):
    """Proximal gradient: another method than the one under test."""
    n = len(y)
    w = np.zeros(x.shape[1])
    step = 1 / np.linalg.eigvalsh(x.T @ x / n).max()
    for _ in range(rounds):
        move = w - step * (x.T @ (x @ w - y) / n)
        w = np.sign(move) * np.maximum(abs(move) - step * alpha, 0)
    return w


def test_statistics_equal_numpy(spark, data):
    x, y = data
    df, names = table(spark, x, y)
    got = regression_moments(df, names, "y")
    full = np.column_stack([x, y])
    assert got.n == 300
    assert got.mean == pytest.approx(full.mean(0), rel=1e-12)
    assert got.cov == pytest.approx(np.cov(full.T, bias=True), rel=1e-9)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_statistics_do_not_depend_on_partitions(spark, data, partitions):
    x, y = data
    df, names = table(spark, x + 1e6, y, partitions)
    got = regression_moments(df, names, "y")
    x = x + 1e6 - 1e6  # what the shift leaves of the smallest column
    full = np.column_stack([x, y])
    unit = np.outer(full.std(0), full.std(0))
    assert got.cov / unit == pytest.approx(np.cov(full.T, bias=True) / unit, abs=1e-6)


def test_nulls_and_emptiness_are_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (2.0, None), (float("nan"), 1.0)], "x double, y double")
    with pytest.raises(ValueError, match="3 rows have a null"):
        fit(df, ["x"], "y")
    with pytest.raises(ValueError, match="no rows"):
        fit(df.where("x > 5 and y > 5"), ["x"], "y")


def test_null_handling(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (3.0, 7.0)], "x double, y double")
    assert fit(df, ["x"], "y", handle_null="drop").n == 2
    zero = fit(df, ["x"], "y", handle_null="zero")
    slope, intercept = np.polyfit([1, 0, 3], [2, 1, 7], 1)
    assert zero.raw_coefficients == pytest.approx([slope])
    assert zero.raw_intercept == pytest.approx(intercept)
    with pytest.raises(ValueError, match="unknown null handling"):
        fit(df, ["x"], "y", handle_null="ignore")


def test_ols(spark, data):
    x, y = data
    df, names = table(spark, x, y)
    model = fit(df, names, "y")
    sx, sy = scaled(x, y)
    assert model.coefficients == pytest.approx(np.linalg.lstsq(sx, sy, rcond=None)[0], rel=1e-8)
    raw = np.linalg.lstsq(np.column_stack([x, np.ones(len(y))]), y, rcond=None)[0]
    assert model.raw_coefficients == pytest.approx(raw[:-1], rel=1e-7)
    assert model.raw_intercept == pytest.approx(raw[-1], rel=1e-6)
    assert (model.rank, model.n) == (3, 300)
    unscaled = fit(df, names, "y", standardize=False)
    assert unscaled.coefficients == pytest.approx(raw[:-1], rel=1e-7)
    assert unscaled.intercept == pytest.approx(raw[-1], rel=1e-6)


@pytest.mark.parametrize("alpha", [1.0, 5.0])
def test_ridge(spark, data, alpha):
    x, y = data
    df, names = table(spark, x, y)
    sx, sy = scaled(x, y)
    expected = np.linalg.solve(sx.T @ sx + alpha * np.eye(3), sx.T @ sy)
    assert fit(df, names, "y", "ridge", alpha).coefficients == pytest.approx(expected, rel=1e-9)
    cx, cy = x - x.mean(0), y - y.mean()
    plain = np.linalg.solve(cx.T @ cx + alpha * np.eye(3), cx.T @ cy)
    got = fit(df, names, "y", "ridge", alpha, standardize=False)
    assert got.coefficients == pytest.approx(plain, rel=1e-7)


@pytest.mark.parametrize("alpha", [0.01, 0.1, 0.5])
def test_lasso(spark, data, alpha):
    x, y = data
    df, names = table(spark, x, y)
    expected = brute_lasso(*scaled(x, y), alpha)
    assert fit(df, names, "y", "lasso", alpha).coefficients == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("model_type,alpha", [("ols", 0.0), ("ridge", 4.0), ("lasso", 0.05)])
def test_agrees_with_mllib(spark, data, model_type, alpha):
    sx, sy = scaled(*data)
    df, names = table(spark, sx, sy)
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(df)
    library = LinearRegression(
        featuresCol="v", labelCol="y", standardization=False, tol=1e-12, maxIter=500,
        regParam=alpha / len(sy) if model_type == "ridge" else alpha,
        elasticNetParam=1.0 if model_type == "lasso" else 0.0,
    ).fit(vectors)
    mine = fit(df, names, "y", model_type, alpha)
    assert mine.coefficients == pytest.approx(library.coefficients.toArray(), abs=1e-6)


def test_rank_deficient_ols_is_the_shortest_solution(spark, data):
    x, y = data
    wide = np.column_stack([x[:, 0], x[:, 1], x[:, 0] + x[:, 1], np.full(len(y), 5.0)])
    df, names = table(spark, wide, y)
    model = fit(df, names, "y")
    sx = wide - wide.mean(0)
    sx[:, :3] /= sx[:, :3].std(0)
    expected = np.linalg.lstsq(sx, (y - y.mean()) / y.std(), rcond=1e-9)[0]
    assert model.coefficients == pytest.approx(expected, abs=1e-7)
    assert model.rank == 2
    assert model.coefficients[3] == 0


def test_constant_target(spark):
    df, names = table(spark, np.arange(6.0).reshape(6, 1), np.full(6, 3.0))
    model = fit(df, names, "y")
    assert model.coefficients == pytest.approx([0.0])
    row = evaluate(df, model).first()
    assert (row["r2"], row["rmse"]) == (1.0, 0.0)
    assert [r["prediction"] for r in predict(df, model).collect()] == [3.0] * 6


def test_extreme_penalties(spark, data):
    x, y = data
    df, names = table(spark, x, y)
    statistics = regression_moments(df, names, "y")
    near = solve(statistics, "ridge", 1e-9).coefficients
    assert near == pytest.approx(solve(statistics, "ols").coefficients, rel=1e-6)
    assert solve(statistics, "ridge", 0.0).coefficients == pytest.approx(solve(statistics).coefficients)
    assert not solve(statistics, "lasso", 10.0).coefficients.any()
    assert solve(statistics, "lasso", 0.0).coefficients == pytest.approx(solve(statistics).coefficients, abs=1e-8)


def test_unknown_model_type(spark):
    df, names = table(spark, np.eye(3), np.ones(3))
    with pytest.raises(ValueError, match="unknown model type"):
        fit(df, names, "y", "elastic")
    with pytest.raises(ValueError, match="not in the data"):
        fit(df, ["nope"], "y")
    with pytest.raises(ValueError, match="must differ"):
        fit(df, ["x0", "x0"], "y")
    with pytest.raises(ValueError, match="at least one"):
        fit(df, [], "y")


@pytest.mark.parametrize("scale", ["original", "model"])
def test_predictions_and_metrics(spark, data, scale):
    x, y = data
    df, names = table(spark, x, y, 1)
    model = fit(df, names, "y", "ridge", 2.0)
    sx, _ = scaled(x, y)
    expected = sx @ model.coefficients
    if scale == "original":
        expected = expected * y.std() + y.mean()
    got = [r["prediction"] for r in predict(df, model, scale).collect()]
    assert got == pytest.approx(expected, rel=1e-8, abs=1e-8)
    row = evaluate(df, model, scale).first()
    error = y - expected
    assert row["mse"] == pytest.approx((error**2).mean())
    assert row["rmse"] == pytest.approx(np.sqrt((error**2).mean()))
    assert row["mae"] == pytest.approx(abs(error).mean())
    assert row["r2"] == pytest.approx(1 - (error**2).sum() / ((y - y.mean()) ** 2).sum())
    with pytest.raises(ValueError, match="unknown scale"):
        predict(df, model, "log")


def test_model_table_round_trip(spark, data):
    df, names = table(spark, *data)
    model = fit(df, names, "y", "lasso", 0.02)
    again = model_from_table(model_table(spark, model))
    assert again.features == model.features and again.model_type == "lasso"
    for part in ("coefficients", "x_mean", "x_scale"):
        assert list(getattr(again, part)) == list(getattr(model, part))
    assert (again.intercept, again.y_mean, again.y_scale, again.alpha) == (
        model.intercept, model.y_mean, model.y_scale, model.alpha,
    )


def test_coefficient_table_ends_with_the_intercept(spark, data):
    df, names = table(spark, *data)
    rows = coefficient_table(spark, fit(df, names, "y")).orderBy("position").collect()
    assert [r["feature"] for r in rows] == [*names, "intercept"]


def test_model_summary(spark, data):
    df, names = table(spark, *data)
    model = fit(df, names, "y")
    rows = {(r[0], r[1]): r[2] for r in model_summary(spark, model, evaluate(df, model)).collect()}
    assert rows["model", "features"] == "3" and rows["model", "target"] == "y"
    assert float(rows["coefficient", "x0"]) == pytest.approx(model.coefficients[0], abs=1e-6)
    assert len(rows) == 3 + 4 + 4


def test_model_comparison_equals_single_fits(spark, data):
    df, names = table(spark, *data)
    rows = {r["model_type"]: r for r in compare_models(df, names, "y").collect()}
    assert set(rows) == {"ols", "ridge", "lasso"}
    for kind, row in rows.items():
        alone = evaluate(df, fit(df, names, "y", kind)).first()
        assert row["mse"] == pytest.approx(alone["mse"])


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, c double")
    rows = sorted(standardize(df, ["a", "c"]).collect())
    values = np.array([1, 2, 6.0])
    assert [r["a_std"] for r in rows] == pytest.approx((values - 3) / values.std())
    assert [r["c_std"] for r in rows] == [0, 0, 0]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.integers(1, 12), st.integers(30, 80), st.integers(0, 10_000), st.sampled_from([0.0, 1e5])
)
def test_fitted_values_equal_least_squares(spark, k, n, seed, shift):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) + shift
    y = x @ rng.normal(size=k) + rng.normal(size=n)
    df, names = table(spark, x, y, 1)
    centred = x - x.mean(0)
    expected = centred @ np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0] + y.mean()
    got = [r["prediction"] for r in predict(df, fit(df, names, "y")).collect()]
    assert got == pytest.approx(expected, rel=1e-6, abs=1e-3)


def test_calendar_dummies_are_collinear_but_fitted_values_hold(spark):
    rng = np.random.default_rng(4)
    month = rng.integers(1, 13, size=400)
    x = np.column_stack(
        [*[(month == m) for m in range(2, 13)], *[((month + 2) // 3 == q) for q in range(2, 5)]]
    ).astype(float)
    y = month * 2.0 + rng.normal(size=400)
    df, names = table(spark, x, y, 1)
    model = fit(df, names, "y")
    assert model.rank == 11
    expected = np.array([y[month == m].mean() for m in month])
    got = [r["prediction"] for r in predict(df, model).collect()]
    assert got == pytest.approx(expected, abs=1e-6)


def test_metrics_are_over_complete_rows(spark):
    rng = np.random.default_rng(5)
    x, noise = rng.normal(size=200), rng.normal(size=200)
    rows = [(float(a), float(2 * a + e)) for a, e in zip(x, noise)]
    whole = spark.createDataFrame(rows, "x double, y double")
    model = fit(whole, ["x"], "y")
    gaps = [(None if i % 3 == 0 else a, b) for i, (a, b) in enumerate(rows)]
    found = evaluate(spark.createDataFrame(gaps, "x double, y double"), model).first()
    kept = [(a, b) for a, b in gaps if a is not None]
    expected = evaluate(spark.createDataFrame(kept, "x double, y double"), model).first()
    assert found["n"] == len(kept)
    assert found["r2"] == pytest.approx(expected["r2"], abs=1e-12)
