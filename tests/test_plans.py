"""What Spark makes of the operators: scans, shuffles, joins."""

import re

import pytest

from spendlens.operators import features, regression, series
from spendlens.plans import queries, trade_panel
from spendlens.plans.preprocess import preprocess
from spendlens.session import shared_path
from spendlens.sources import writers


def plan(df):
    """The plan before adaptive execution, with details."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def tree(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"\bExchange (hash|range|round)partitioning|Exchange SinglePartition", tree(df)))


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    """The panel as a table on disk."""
    path = writers.write_parquet(queries.panel(spark, sf_dir), shared_path(spark, "panel"))
    return spark.read.parquet(path)


def test_lags_and_promotion_counts_share_one_shuffle(stored):
    prepared = preprocess(stored, queries.PANEL_CONFIG)
    wanted = prepared.df.select(
        "geo", "week", "cost_high_lag1", "cost_low_lag2", "log_organic_lag1", "promo_intensity"
    )
    assert shuffles(wanted) == 1


def test_whole_feature_table_needs_one_shuffle(stored):
    assert shuffles(preprocess(stored, queries.PANEL_CONFIG).df) == 1


def test_unused_features_are_not_computed(stored):
    prepared = preprocess(stored, queries.PANEL_CONFIG)
    few = tree(prepared.df.select("geo", "cost_high_log"))
    assert "ReadSchema: struct<geo:string,cost_high:double>" in few
    assert "Window" not in few and "Exchange" not in few


def test_adstock_steps_share_one_shuffle_and_one_sort(stored):
    laid_out = series.as_series(stored)
    carried = series.adstock(laid_out, queries.DECAY).result()
    assert shuffles(carried) == 1
    assert len(re.findall(r"\bSort \[", tree(carried))) == 1


def test_lags_of_all_columns_share_one_window(stored):
    lagged = features.add_spend_lags(series.as_series(stored), queries.SPEND).result()
    assert len(re.findall(r"\bWindow \[", tree(lagged))) == 1


def test_series_tables_need_no_shuffle(stored):
    spark = stored.sparkSession
    name = writers.write_series_table(stored, "stored_series", shared_path(spark, "series"), 8)
    table = spark.table(name)
    lagged = features.add_spend_lags(series.as_series(table), queries.SPEND).result()
    assert shuffles(lagged) == 0
    assert shuffles(preprocess(table, queries.PANEL_CONFIG).df) == 0
    plain = features.add_spend_lags(series.as_series(stored.where("geo is not null")), queries.SPEND).result()
    columns = ["geo", "week", *[c for c in plain.columns if "_lag" in c]]
    unique = lagged.where("geo is not null").select(*columns)
    assert unique.groupBy("geo", "week").count().count() == plain.groupBy("geo", "week").count().count()
    assert unique.exceptAll(plain.select(*columns)).count() == 0


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    shown = plan(trade_panel.build_promotions(spark, sf_dir))
    assert "GreaterThanOrEqual(l_discount,0.085)" in shown
    lines = re.search(r"ReadSchema: struct<([^>]*l_discount[^>]*)>", shown).group(1)
    assert {c.split(":")[0] for c in lines.split(",")} == {"l_orderkey", "l_partkey", "l_discount"}


def test_lines_are_summed_before_they_are_joined(spark, sf_dir):
    shown = tree(trade_panel.build_panel(spark, sf_dir))
    scan = shown.index("l_extendedprice", shown.index("FileScan parquet [l_orderkey"))
    above = shown[:scan]
    # Nearest above the scan: partial sums per order, then their shuffle.
    assert above.rindex("partial_sum") > above.rindex("Join")


def test_predictions_stay_in_generated_code(stored):
    model = regression.fit(stored, queries.SPEND, "revenue")
    shown = tree(regression.predict(stored, model))
    assert "Python" not in shown and "Exchange" not in shown


@pytest.mark.parametrize(
    "name",
    [
        "build_panel", "build_promotions", "import_panel", "join_promotions",
        "join_common_columns", "median_fill",
        "ffill_bfill_segmented", "spend_lags_segmented", "adstock_channels_segmented",
        "promo_intensity_hot_key", "preprocess_wide", "feature_matrix", "mroas",
    ],
)
def test_no_cross_join_and_no_row_python(name, spark, sf_dir):
    shown = tree(queries.QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in shown
