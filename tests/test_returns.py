import numpy as np
import pytest

from spendlens.operators.regression import LinearModel
from spendlens.operators.returns import (
    contribution,
    elasticity,
    log_elasticity,
    marginal_roas,
    promo_impact,
    scenario_lift,
    top_contribution,
    top_elasticity,
)


def model(features, weights, x_scale=None, y_scale=2.0):
    k = len(features)
    return LinearModel(
        "ols", 0.0, tuple(features), "revenue", np.array(weights, float), 0.0,
        np.zeros(k), np.array(x_scale or [1.0] * k), 0.0, y_scale, np.full(k, 2.0), 20.0, k, 3,
    )


@pytest.fixture
def df(spark):
    rows = [(1.0, 0.0, 10.0, 1), (2.0, 0.0, 20.0, 0), (3.0, 0.0, 30.0, 0)]
    return spark.createDataFrame(rows, "cost_a_log double, cost_b_log double, revenue double, has_promotion long")


def test_elasticity(df):
    m = model(["cost_a_log", "cost_b_log"], [5.0, 7.0], [4.0, 1.0])
    rows = {r["feature"]: r for r in elasticity(df, m).collect()}
    assert rows["cost_a_log"]["elasticity"] == pytest.approx(5 * 2 / 20)
    assert rows["cost_b_log"]["elasticity"] == 0.0
    raw = elasticity(df, m, ["cost_a_log"], "original").first()
    assert (raw["elasticity"], raw["coef_scale"]) == (pytest.approx(5 * 2 / 4 * 2 / 20), "original")
    assert log_elasticity(df, m, ["cost_a_log", "cost_z_log"]).first()["channel"] == "a"
    with pytest.raises(ValueError, match="not in the data"):
        elasticity(df, m, ["cost_z_log"])


def test_training_rows_need_no_further_pass(spark, df):
    """The model above holds the means of ``df`` for its first feature."""
    m = model(["cost_a_log"], [0.5])
    assert elasticity(None, m).collect() == elasticity(df, m).collect()
    assert contribution(None, m).collect() == contribution(df, m).collect()
    for raw in (None, spark.createDataFrame([(40.0,)], "cost_a double")):
        known = marginal_roas(None, m, ["cost_a_log"], raw).collect()
        assert known == marginal_roas(df, m, ["cost_a_log"], raw).collect()
    with pytest.raises(ValueError, match="not in the model"):
        elasticity(None, m, ["cost_b_log"])


def test_zero_mean_target_gives_zero(spark):
    df = spark.createDataFrame([(1.0, -1.0), (2.0, 1.0)], "cost_a double, revenue double")
    m = model(["cost_a"], [3.0])
    assert elasticity(df, m).first()["elasticity"] == 0.0
    assert contribution(df, m).first()["contribution_pct"] == 0.0


def test_contribution_is_sorted(df):
    m = model(["has_promotion", "cost_b_log", "cost_a_log"], [-3.0, 1.0, 2.0])
    rows = contribution(df, m).collect()
    assert [r["feature"] for r in rows] == ["cost_a_log", "cost_b_log", "has_promotion"]
    assert rows[0]["contribution_pct"] == pytest.approx(2 * 2 / 20 * 100)
    assert rows[2]["contribution_pct"] == pytest.approx(-3 * (1 / 3) / 20 * 100)


def test_top_lists(spark):
    rows = [(f"f{i}", float(v)) for i, v in enumerate([1, -9, 3, 2, 8, -4, 0])]
    t = spark.createDataFrame(rows, "feature string, elasticity double")
    assert [r["elasticity"] for r in top_elasticity(t).collect()] == [-9, 8, -4, 3, 2]
    c = t.withColumnRenamed("elasticity", "contribution_pct")
    assert [r["contribution_pct"] for r in top_contribution(c).collect()] == [8, 3, 2, 1, 0]


def test_mroas(spark, df):
    raw = spark.createDataFrame([(10.0, 0.0), (30.0, None)], "cost_a double, cost_b double")
    m = model(["cost_a_log", "cost_b_log"], [0.5, 7.0])
    rows = marginal_roas(df, m, ["cost_a_log", "cost_b_log", "cost_z_log"], raw).collect()
    assert len(rows) == 1  # b has no spend, z is not in the model
    row = rows[0]
    assert (row["channel"], row["total_sales"], row["total_spend"], row["spend_basis"]) == ("a", 60, 40, "total")
    assert row["mroas"] == pytest.approx(0.75)
    assert row["mroas_interpretation"] == "$0.75 revenue per $1 spend"


def test_mroas_without_raw_spend_uses_a_mean(spark, df):
    row = marginal_roas(df, model(["cost_a_log"], [0.5]), ["cost_a_log"]).first()
    assert row["total_spend"] == pytest.approx(np.exp(2) - 1)
    assert row["spend_basis"] == "mean"
    plain = spark.createDataFrame([(4.0, 8.0), (6.0, 2.0)], "cost_a double, revenue double")
    assert marginal_roas(plain, model(["cost_a"], [1.0]), ["cost_a"]).first()["total_spend"] == 5
    exact = marginal_roas(plain, model(["cost_a"], [1.0]), ["cost_a"], plain).first()
    assert exact["total_spend"] == 10


def test_mroas_of_nothing_is_an_empty_table(df):
    table = marginal_roas(df, model(["cost_a_log"], [0.5]), ["cost_z_log"])
    assert table.count() == 0 and "mroas" in table.columns


def test_promo_impact(df):
    m = model(["has_promotion", "cost_a_log"], [0.25, 1.0])
    rows = promo_impact(df, m, ["has_promotion", "promo_intensity"]).collect()
    assert [(r["feature"], r["coefficient"], r["impact"]) for r in rows] == [("has_promotion", 0.25, 5.0)]
    assert promo_impact(df, m, ["promo_intensity"]).count() == 0


def test_scenario(spark):
    raw = spark.createDataFrame([(10.0,), (30.0,)], "cost_a double")
    m = model(["cost_a_log"], [0.5])
    row = scenario_lift(raw, m, {"cost_a": 1.2}).first()
    assert row["scenario_spend"] == pytest.approx(48)
    assert row["lift"] == pytest.approx(0.5 * np.log(1.2))
    with pytest.raises(ValueError, match="must be positive"):
        scenario_lift(raw, m, {"cost_a": 0.0})
    with pytest.raises(ValueError, match="not in the model"):
        scenario_lift(raw.withColumnRenamed("cost_a", "cost_b"), m, {"cost_b": 2.0})
