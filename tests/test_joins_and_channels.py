import pytest

from spendlens.operators.channels import (
    channel_table,
    discover_channels,
    drop_columns_like,
    drop_empty_channels,
)
from spendlens.operators.joins import join_common_columns, join_promotions, left_join_null_safe
from spendlens.operators.nulls import fill_zero, model_dataset

@pytest.fixture
def panel(spark):
    rows = [("w1", "a", 1.0), ("w1", None, 2.0), (None, "a", 3.0), ("w2", "b", 4.0)]
    return spark.createDataFrame(rows, "week string, geo string, revenue double")


@pytest.fixture
def promos(spark):
    rows = [("w1", "a", "p"), ("w1", "a", "q"), ("w1", None, "r"), ("w9", "z", "s")]
    return spark.createDataFrame(rows, "week string, geo string, promo_description string")


def test_promotions_fan_out_and_null_keys_match(panel, promos):
    got = join_promotions(panel, promos)
    assert got.columns == ["week", "geo", "revenue", "promo_description"]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(
        [
            ("w1", "a", 1.0, "p"), ("w1", "a", 1.0, "q"), ("w1", None, 2.0, "r"),
            (None, "a", 3.0, None), ("w2", "b", 4.0, None),
        ],
        key=key,
    )


def test_identical_rows_of_a_hot_key_are_all_kept(spark, panel, promos):
    many = promos.where("geo = 'a'").selectExpr("*", "explode(sequence(1, 500)) as copy").drop("copy")
    got = join_promotions(panel.where("revenue = 1"), many)
    assert got.count() == 1000


def test_missing_key_falls_back_to_common_columns(spark, panel, promos):
    by_geo = promos.drop("week").where("geo = 'a'").limit(1)
    assert join_promotions(panel, by_geo).where("promo_description is not null").count() == 2
    unrelated = spark.createDataFrame([(1,)], "other int")
    assert join_common_columns(panel, unrelated) is panel


def test_overlapping_columns_are_rejected(panel, promos):
    with pytest.raises(ValueError, match="besides the keys: revenue"):
        left_join_null_safe(panel, panel, ["week", "geo"])


@pytest.fixture
def wide(spark):
    rows = [("a", 1.0, None, 5.0, None, 2.0, None, 1, 1.0)]
    return spark.createDataFrame(
        rows,
        "geo string, cost_tv double, impression_tv double, Cost_radio double, "
        "cost_outdoor2 double, impression_outdoor2 double, impression_organic double, "
        "cost_int int, revenue double",
    )


def test_channels_are_double_or_long_columns(wide):
    found = discover_channels(wide)
    assert found.cost_columns == ["cost_tv", "Cost_radio", "cost_outdoor2"]
    assert found.names == ["tv", "radio", "outdoor2"]
    assert found.impression_columns == ["impression_tv", "impression_outdoor2", "impression_organic"]


def test_channel_table(wide):
    rows = {r["channel"]: r for r in channel_table(wide).collect()}
    assert (rows["tv"]["cost_rows"], rows["tv"]["impression_rows"]) == (1, 0)
    assert rows["radio"]["impression_column"] is None
    assert channel_table(wide.select("geo")).count() == 0


def test_drop_by_name_ignores_case(wide):
    assert "cost_outdoor2" not in drop_columns_like(wide, "OUTDOOR2").columns
    assert drop_columns_like(wide, "nowhere").columns == wide.columns


def test_empty_channels_go_with_all_their_columns(wide):
    kept = drop_empty_channels(wide).columns
    assert "cost_tv" not in kept and "impression_outdoor2" not in kept
    assert "impression_organic" in kept
    assert drop_empty_channels(wide.limit(0)).columns == wide.columns


def test_fill_zero_and_complete_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None), (3.0, 4.0)], "x double, y double")
    assert sorted(map(tuple, fill_zero(df).collect())) == [(0, 1), (2, 0), (3, 4)]
    assert [tuple(r) for r in model_dataset(df, "y", ["x"]).collect()] == [(3, 4)]
    with pytest.raises(ValueError, match="not in the data: z"):
        model_dataset(df, "y", ["x"], ["z"])


def test_only_the_start_of_a_name_makes_a_channel(spark):
    columns = "cost_logistics double, cost_low_cost_air double, impression_low_cost_air double, total_cost double"
    found = discover_channels(spark.createDataFrame([], columns))
    assert found.names == ["logistics", "low_cost_air"]
    assert found.cost_columns == ["cost_logistics", "cost_low_cost_air"]
    assert found.impression_columns == ["impression_low_cost_air"]
