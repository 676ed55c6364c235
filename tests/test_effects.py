import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.operators import encode, iterative
from spendlens.operators.effects import evaluate_effects, fit_effects, predict_effects
from spendlens.operators.regression import evaluate, fit
from spendlens.plans import jobs
from tests.test_regression import brute_lasso, scaled


@pytest.fixture(scope="module")
def rows(spark):
    """Ten geos and rows without one; a feature that is constant in a geo, and one that is a sum of others."""
    rng = np.random.default_rng(4)
    out = []
    for i in range(400):
        geo = None if i % 13 == 0 else f"g{i % 10}"
        a, b = rng.normal(50, 9), rng.normal()
        size = 7.0 if geo is None else 100.0 * int(geo[1:]) ** 2 + 7
        y = 3 * a - 20 * b + 0.1 * size + rng.normal() * 4 + (0 if geo is None else 11 * int(geo[1:]))
        out.append((geo, a, b, size, a + 2 * b, 1.0, float(y)))
    return spark.createDataFrame(out, "geo string, a double, b double, size double, both double, one double, y double")


def dense(rows, features, **how):
    wide = encode.add_geo_fixed_effects(rows)
    names = [c for c in wide.columns if c.startswith("geo_fe_")]
    return wide, fit(wide, [*features, *names], "y", **how), names


@pytest.mark.parametrize("features", [["a", "b"], ["a", "b", "size"], ["both", "a", "size", "one", "b"]])
@pytest.mark.parametrize("how", [{}, {"standardize": False}, {"model_type": "ridge", "alpha": 30.0}])
def test_equals_the_fit_on_columns(spark, rows, features, how):
    wide, want, names = dense(rows, features, **how)
    got = fit_effects(rows, features, "y", "geo", **how)
    np.testing.assert_allclose(got.model.coefficients, want.coefficients[: len(features)], rtol=1e-6, atol=1e-7)
    effects = {r["geo"]: r for r in got.effects.collect()}
    by_name = dict(zip(want.features, zip(want.raw_coefficients, want.coefficients)))
    assert sorted(f"geo_fe_{g}" for g in effects) == sorted(names)
    for geo, r in effects.items():
        np.testing.assert_allclose((r["effect"], r["coefficient"]), by_name[f"geo_fe_{geo}"], rtol=1e-6, atol=1e-6)
    assert abs(got.model.raw_intercept - want.raw_intercept) < 1e-5
    assert (got.model.rank, got.model.n, got.levels) == (want.rank, want.n, 10)
    metrics = [evaluate(wide, want).first(), evaluate_effects(rows, got).first()]
    for name in ("r2", "rmse", "mae", "mse"):
        assert metrics[0][name] == pytest.approx(metrics[1][name], rel=1e-6)


def test_conjugate_gradients_equal_the_fit_on_columns(spark, rows):
    features = ["both", "a", "size", "one", "b"]
    for how in ({}, {"model_type": "ridge", "alpha": 30.0}):
        _, want, names = dense(rows, features, **how)
        got = iterative.fit_sparse(encode.add_sparse_effects(rows, ["geo"]), features, "y", **how)
        assert got.converged
        np.testing.assert_allclose(got.coefficients, want.coefficients, rtol=1e-5, atol=1e-6)
        assert got.raw_intercept == pytest.approx(want.raw_intercept, abs=1e-3)


def test_lasso_over_levels(spark, rows):
    features = ["a", "b", "size"]
    wide, _, names = dense(rows, features)
    x = np.array([[float(r[c]) for c in [*features, *names]] for r in wide.collect()])
    y = np.array([r["y"] for r in wide.collect()])
    got = iterative.fit_sparse(encode.add_sparse_effects(rows, ["geo"]), features, "y", "fixed_effects", "lasso", 0.05)
    np.testing.assert_allclose(got.coefficients, brute_lasso(*scaled(x, y), 0.05), atol=1e-6)
    short = iterative.fit_sparse(
        encode.add_sparse_effects(rows, ["geo"]), features, "y", "fixed_effects", "lasso", 0.05, max_steps=25
    )
    assert got.converged and not short.converged and np.isfinite(short.coefficients).all()


def test_a_hundred_thousand_levels(spark):
    """As many levels as no table has columns, with and without elimination."""
    n = 100_000
    df = spark.range(3 * n).select(
        (F.col("id") % n).cast("string").alias("geo"),
        F.rand(3).alias("x"), F.randn(4).alias("e"),
    )
    df = df.withColumn("y", 5 * F.col("x") + F.crc32(F.col("geo").cast("binary")) % 97 + 0.1 * F.col("e")).checkpoint()
    got = fit_effects(df, ["x"], "y", "geo")
    assert got.levels == n and got.effects.count() == n - 1
    assert got.model.raw_coefficients[0] == pytest.approx(5, abs=0.01)
    assert evaluate_effects(df, got).first()["rmse"] < 0.1
    few = df.where(F.col("geo").cast("int") < 20_000)
    sparse = iterative.fit_sparse(encode.add_sparse_effects(few, ["geo"]), ["x"], "y")
    assert sparse.converged and len(sparse.coefficients) == 20_000
    own = fit_effects(few, ["x"], "y", "geo")
    assert sparse.raw_coefficients[0] == pytest.approx(own.model.raw_coefficients[0], abs=1e-6)


def test_edge_cases(spark, rows):
    with pytest.raises(ValueError, match="lasso"):
        fit_effects(rows, ["a"], "y", "geo", "lasso")
    with pytest.raises(ValueError, match="null in a feature"):
        fit_effects(rows.withColumn("a", F.when(F.col("b") > 0, F.col("a"))), ["a"], "y", "geo")
    with pytest.raises(ValueError, match="no rows"):
        iterative.fit_sparse(encode.add_sparse_effects(rows.limit(0), ["geo"]), ["a"], "y")
    nowhere = rows.withColumn("geo", F.lit(None).cast("string"))
    want = fit(rows, ["a", "b"], "y")
    for df, levels in ((nowhere, 0), (rows.withColumn("geo", F.lit("x")), 1)):
        got = fit_effects(df, ["a", "b"], "y", "geo")
        np.testing.assert_allclose(got.model.coefficients, want.coefficients, rtol=1e-9)
        assert (got.levels, got.effects.count(), got.model.rank) == (levels, 0, 2)
    unseen = predict_effects(rows.withColumn("geo", F.lit("new")), fit_effects(rows, ["a"], "y", "geo"))
    assert unseen.where("prediction IS NULL").count() == 0 and "level_effect" not in unseen.columns


def test_full_model_with_a_vector_equals_the_one_with_columns(spark):
    rng = random.Random(3)
    rows = [
        (dt.date(2022, 1, 3) + dt.timedelta(weeks=w), g, rng.random() * 100, rng.random() * 9, 100.0 * i, 0.1 * i,
         50.0 * i + rng.random() * 200, rng.choice(["Rabat", None, "free od"]))
        for w in range(60) for i, g in enumerate("abcd")
    ]
    raw = spark.createDataFrame(
        rows, "week date, geo string, cost_tv double, impression_tv double, population double, market_share double, "
        "revenue double, promo_description string",
    )
    wide, narrow = (jobs.fit_full_model(raw, {"fixed_effects_form": form}) for form in ("columns", "vector"))
    own = [f for f in wide.features if not f.startswith("geo_fe_")]
    assert list(narrow.model.features) == own and narrow.model.rank == wide.model.rank
    for f in own:
        assert narrow.model.coefficient(f) == pytest.approx(wide.model.coefficient(f), abs=1e-6)
    a, b = wide.metrics().first(), narrow.metrics().first()
    assert a["r2"] == pytest.approx(b["r2"], abs=1e-9) and a["n"] == b["n"]
    with pytest.raises(ValueError, match="n_geo"):
        jobs.fit_full_model(raw, {"fixed_effects_form": "vector"}, n_geo=2)
