import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.operators.features import balanced_features
from spendlens.operators.regression import predict
from spendlens.plans import jobs
from spendlens.plans.preprocess import preprocess, preprocess_summary, with_defaults
from spendlens.session import shared_path
from spendlens.sources import readers, writers

CHANNELS = ["tiktok", "tv", "outdoor1", "outdoor2", "google", "facebook"]
COLUMNS = (
    ["week", "geo"]
    + [f"cost_{c}" for c in CHANNELS]
    + [f"impression_{c}" for c in CHANNELS]
    + ["impression_organic", "revenue", "conversions", "promo_description", "population", "market_share"]
)
SCHEMA = ", ".join(
    f"{c} {t}"
    for c, t in zip(
        COLUMNS,
        ["date", "string"] + ["double"] * 14 + ["long", "string", "long", "double"],
    )
)


def weekly_panel(spark, geos=40, weeks=155, seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(geos):
        for w in range(weeks):
            cost = [rng.random() * 100 for _ in CHANNELS]
            seen = [rng.random() * 1e4 for _ in CHANNELS]
            seen[3] = None
            if rng.random() < 0.05:
                seen[1] = None
            promo = rng.choice([None, None, "Rabat -15%", "Darmowa dostawa", "komplet"])
            revenue = 50 + 3 * cost[0] + 2 * np.log1p(cost[1]) + (20 if promo else 0) + rng.gauss(0, 5)
            rows.append(
                (
                    dt.date(2022, 1, 3) + dt.timedelta(weeks=w), f"Geo{g}", *cost, *seen,
                    rng.random() * 1e3, float(revenue), rng.randrange(100), promo, 1000 + g, rng.random(),
                )
            )
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def raw(spark):
    return weekly_panel(spark, 12, 60).persist()


def test_forty_geos_and_155_weeks_give_312_columns(spark):
    raw = weekly_panel(spark)
    assert (raw.count(), len(raw.columns)) == (6200, 20)
    prepared = preprocess(raw)
    sets = prepared.sets
    assert len(prepared.df.columns) == 312
    sizes = {name: len(features) for name, features in sets.items()}
    assert sizes["geo_fixed_effects"] == 39
    assert sizes["week_fixed_effects"] == 154
    assert sizes["seasonal_features"] == 65
    assert sizes["lagged_spend_features"] == 11
    assert sizes["promotional_features"] == 7
    assert sizes["impression_features"] == 6
    assert prepared.channels.names == ["tiktok", "tv", "outdoor1", "google", "facebook"]
    assert sets["control_vars"] == ["population", "market_share", "log_organic", "log_organic_lag1"]
    assert len(balanced_features(sets, 10, 20)) == 46
    assert not [f for f in sets["all_features"] if "_fe_" in f or f.startswith("month_")]
    summary = preprocess_summary(prepared).first()
    assert (summary["n_rows"], summary["n_columns"]) == (6200, 312)
    nulls = raw.where("promo_description is null").count()
    assert summary["missing_values"] == nulls
    assert summary["completeness_pct"] == round((1 - nulls / 6200 / 312) * 100, 1)


def test_columns_keep_the_documented_order(raw):
    columns = preprocess(raw).df.columns
    marks = [
        "market_share", "cpm_tiktok", "cost_tiktok_log", "impression_organic_log", "has_promotion",
        "discount_percent", "promo_intensity", "cost_tiktok_lag1", "geo_fe_Geo1",
        "week_fe_2022-01-10", "month_2", "quarter_2", "week_of_year_2", "log_organic", "log_organic_lag1",
    ]
    places = [columns.index(m) for m in marks]
    assert places == sorted(places)


def test_partial_config_keeps_the_other_defaults(raw):
    prepared = preprocess(
        raw, {"create_lags": True, "lag_periods": [1, 2, 3], "create_seasonality": False}
    )
    assert "cost_tv_lag3" in prepared.df.columns
    assert prepared.sets["seasonal_features"] == []
    assert with_defaults({"lag_periods": [4], "typo": 1})["lag_periods"] == [4]
    assert "typo" not in with_defaults({"typo": 1})


@pytest.mark.parametrize(
    "config",
    [
        {"create_lags": False},
        {"create_fixed_effects": False},
        {"log_transform": False, "handle_promotions": False},
        {"fillna_method": "ffill"},
        {"fillna_method": "bfill", "remove_outdoor2": False},
        {"fill_tv_impressions": False},
    ],
)
def test_switches(raw, config):
    prepared = preprocess(raw, config)
    assert prepared.df.count() == raw.count()
    columns = prepared.df.columns
    assert ("cost_tv_lag1" in columns) == config.get("create_lags", True)
    assert ("geo_fe_Geo1" in columns) == config.get("create_fixed_effects", True)
    assert ("cost_outdoor2" in columns) == (not config.get("remove_outdoor2", True))
    filled = prepared.df.where("impression_tv is null").count() == 0
    assert filled == config.get("fill_tv_impressions", True)


def test_long_series_give_the_same_table(raw):
    names = [
        "geo", "week", "cost_tv_lag1", "cost_google_lag2", "promo_intensity", "log_organic_lag1",
        "impression_tv", "month_3",
    ]
    whole = preprocess(raw, {"fillna_method": "ffill"}).df.select(*names)
    cut = preprocess(raw, {"fillna_method": "ffill", "max_series_rows": 20}).df.select(*names)
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def test_columns_that_are_missing_are_not_needed(raw):
    bare = raw.drop("promo_description", "impression_organic", "population")
    prepared = preprocess(bare)
    assert "has_promotion" not in prepared.df.columns
    assert prepared.sets["promotional_features"] == ["has_promotion"]
    assert preprocess(raw.drop("geo", "week")).df.count() == raw.count()


def test_full_model_equals_least_squares(spark, raw):
    job = jobs.fit_full_model(raw)
    frame = job.data.toPandas()
    x = frame[job.features].to_numpy(float)
    y = frame["revenue"].to_numpy()
    spread = x.std(0)
    scaled = (x - x.mean(0)) / np.where(spread == 0, 1, spread)
    weights, _, rank, _ = np.linalg.lstsq(scaled, (y - y.mean()) / y.std(), rcond=1e-8)
    assert job.model.rank == rank < len(job.features)
    assert job.model.coefficients == pytest.approx(weights, abs=1e-6)
    predicted = [r["prediction"] for r in predict(job.data, job.model).collect()]
    assert predicted == pytest.approx(scaled @ weights * y.std() + y.mean(), rel=1e-8)
    job.close()


def test_full_analysis_tables(raw):
    tables = jobs.full_analysis(raw)
    assert tables["coefficients"].count() == len(jobs.fit_full_model(raw).features) + 1
    channels = {r["channel"] for r in tables["mroas"].collect()}
    assert channels == {"tiktok", "tv", "outdoor1", "google", "facebook"}
    assert tables["promo_impact"].count() == 7
    assert tables["elasticity"].count() == 5
    assert tables["metrics"].first()["n"] == raw.count()


def test_spend_model_refuses_nulls(spark, raw):
    broken = raw.selectExpr(
        *[c for c in raw.columns if c != "cost_tv"],
        "case when geo = 'Geo3' then null else cost_tv end as cost_tv",
    )
    with pytest.raises(ValueError, match="60 rows have a null"):
        jobs.fit_spend_model(broken)
    assert jobs.fit_spend_model(broken, handle_null="drop").model.n == raw.count() - 60


def test_run_from_csv_to_files(spark, raw):
    source = writers.write_csv(raw, shared_path(spark, "raw"))
    folder = shared_path(spark, "out")
    config = {
        "data": {"source": "local", "path": source, "schema": SCHEMA},
        "model": {"type": "lasso", "alpha": 0.001},
        "output": {"local": {"dir": folder}, "remote": {"enabled": True, "path": folder + "-2"}},
    }
    results = jobs.run(spark, config)
    assert results["data_import"]["shape"] == [720, 20]
    assert results["data_import"]["date_range"]["start"] == "2022-01-03"
    assert results["model_training"] == {
        "status": "SUCCESS", "model_type": "lasso", "model_alpha": 0.001,
    }
    assert results["run"]["status"] == "SUCCESS"
    metrics = results["model_evaluation"]["model_metrics"]
    assert metrics["rmse"] == pytest.approx(metrics["mse"] ** 0.5)
    assert set(results["model_evaluation"]["contribution"]) == {
        f"cost_{c}" for c in CHANNELS if c != "outdoor2"
    }
    files = results["data_export"]["output_files"]
    assert set(files) == {"local", "remote"}
    for place in files.values():
        stored = readers.read_csv(spark, place["processed_data_csv"])
        assert stored.count() == 720
        model = writers.load_model(spark, place["model_table"])
        assert model.model_type == "lasso" and len(model.features) == 5
        names = {r["name"] for r in writers.read_results_json(spark, place["results_json"]).collect()}
        assert {"model_metrics.r2_score", "elasticity.cost_tv", "shape.0"} <= names
    short = {(r["section"], r["name"]) for r in jobs.summary_table(spark, results).collect()}
    assert ("model_evaluation", "model_metrics.mse") not in short
    assert ("model_training", "model_type") in short


def test_outputs_appear_together_or_not_at_all(spark, raw, monkeypatch):
    import os

    job = jobs.fit_spend_model(raw)
    table = job.prepared.df.withColumn("mark", F.expr("uuid()"))
    results = jobs.results_table(spark, {"run": {"status": "SUCCESS"}})
    folders = [shared_path(spark, "one"), shared_path(spark, "two")]
    places = {"local": {"dir": folders[0]}, "remote": {"enabled": True, "path": folders[1]}, "output_prefix": "out"}

    def visible():
        return [sorted(n for n in os.listdir(f) if n[0] not in "_.") if os.path.isdir(f) else [] for f in folders]

    save, calls = writers.save_model, []

    def failing(*given):
        calls.append(given)
        if len(calls) == 2:  # in the second place
            raise OSError("disk full")
        return save(*given)

    monkeypatch.setattr(writers, "save_model", failing)
    with pytest.raises(OSError, match="disk full"):
        writers.export_by_config(spark, table, job.model, results, places)
    assert visible() == [[], []]
    for _ in range(2):  # the second time over the outputs of the first
        files = writers.export_by_config(spark, table, job.model, results, places)
    assert [n for n in os.listdir(folders[0]) if n.startswith("_staged")] == []
    names = ["out_manifest.json", "out_model.parquet", "out_processed_data.csv", "out_processed_data.parquet", "out_results.json"]
    assert visible() == [names, names]
    # One computation feeds both forms in both places: random values agree.
    marks = [
        {r["mark"] for r in stored.select("mark").collect()}
        for f in files.values()
        for stored in (spark.read.parquet(f["processed_data_parquet"]), readers.read_csv(spark, f["processed_data_csv"]))
    ]
    assert len(marks[0]) == 720 and all(m == marks[0] for m in marks)
    manifest = {r["output"]: r["path"] for r in spark.read.json(files["local"]["manifest"]).collect()}
    assert manifest == {k: v for k, v in files["local"].items() if k != "manifest"}
    job.close()


def test_steps_can_be_switched_off(spark, raw):
    off = {"enabled": False}
    only_import = jobs.run(
        spark,
        {
            "data": {"path": writers.write_csv(raw, shared_path(spark, "raw"))},
            "steps": {"model_training": off},
        },
    )
    assert set(only_import) == {"run", "data_import"}
    steps = {"data_import": off, "model_evaluation": off, "data_export": off}
    assert set(jobs.run(spark, {"steps": steps}, raw)) == {"run", "model_training"}
    unsaved = {"steps": {"data_import": off}, "output": {"save_results": False}}
    assert jobs.run(spark, unsaved, raw)["data_export"]["output_files"] == {}
    with pytest.raises(ValueError, match="needs an import step or a panel"):
        seen = {}
        jobs.run(spark, {"steps": {"data_import": off}}, results=seen)
    assert seen["run"]["status"] == "FAILED" and "panel" in seen["run"]["error"]
    with pytest.raises(ValueError, match="set output.local.dir"):
        jobs.run(spark, {"steps": {"data_import": off}}, raw)


def test_text_numbers(spark):
    rows = [("12.5", "abc", "7", "1e3"), ("", None, "x", " -2 "), ("1d", "NaN", "0x1A", ".5")]
    df = spark.createDataFrame(rows, "cost_a string, Revenue string, impression_a string, conversions string")
    got = readers.nan_to_null(readers.coerce_numeric(df)).collect()
    assert [r["cost_a"] for r in got] == [12.5, None, None]
    assert [r["Revenue"] for r in got] == [None, None, None]
    assert [r["impression_a"] for r in got] == ["7", "x", "0x1A"]
    assert [r["conversions"] for r in got] == [1000.0, -2.0, 0.5]


def test_weeks(spark):
    good = spark.createDataFrame([("2022-01-03",)], "week string")
    assert readers.parse_week(good).first()["week"] == dt.date(2022, 1, 3)
    empty = spark.createDataFrame([(None,)], "week string")
    assert readers.parse_week(empty).first()["week"] is None
    with pytest.raises(Exception, match="not a date in week: soon"):
        readers.parse_week(spark.createDataFrame([("soon",)], "week string")).collect()


def test_import_sources(spark, raw):
    table = writers.write_parquet(raw.drop("promo_description"), shared_path(spark, "t"))
    alone = readers.import_panel(spark, "warehouse", table=table, promotions=table + "-none")
    assert "promo_description" not in alone.columns
    promos = raw.select("week", "geo", "promo_description").where("promo_description is not null")
    stored = writers.write_parquet(promos, shared_path(spark, "p"))
    joined = readers.import_panel(spark, "warehouse", table=table, promotions=stored)
    assert joined.count() == raw.count()
    spark.sql("CREATE SCHEMA IF NOT EXISTS marketing")
    for name, part in (("cost_revenue", raw.drop("promo_description")), ("promotions", promos)):
        part.write.mode("overwrite").option("path", shared_path(spark, name)).saveAsTable(
            f"marketing.{name}"
        )
    by_name = readers.import_panel(spark, "warehouse", dataset="marketing")
    assert by_name.count() == raw.count() and "promo_description" in by_name.columns
    raw.limit(3).createOrReplaceTempView("weekly_view")
    assert readers.read_table(spark, "weekly_view").count() == 3
    for broken in ({"source": "ftp"}, {"source": "local"}, {"source": "warehouse"}):
        with pytest.raises(ValueError):
            readers.import_panel(spark, **broken)


def test_quotes_and_nulls_survive_csv(spark):
    rows = [('say "hi", now', 1.0), (None, None), ("", 2.5)]
    df = spark.createDataFrame(rows, "t string, x double")
    path = writers.write_csv(df, shared_path(spark, "quotes"))
    got = {(r["t"], r["x"]) for r in readers.read_csv(spark, path, df.schema).collect()}
    assert ('say "hi", now', 1.0) in got and (None, None) in got


def test_effects_as_a_vector(spark):
    rows = [(dt.date(2022, 1, 3) + dt.timedelta(weeks=w), g, 1.0 * w, 2.0, 3.0) for w in range(4) for g in "abc"]
    raw = spark.createDataFrame(rows, "week date, geo string, cost_tv double, impression_tv double, revenue double")
    wide = preprocess(raw, {"create_seasonality": False})
    narrow = preprocess(raw, {"create_seasonality": False, "fixed_effects_form": "vector"})
    names = [*wide.sets["geo_fixed_effects"], *wide.sets["week_fixed_effects"]]
    dummies = {(r["geo"], r["week"]): [i for i, n in enumerate(names) if r[n]] for r in wide.df.collect()}
    vectors = {(r["geo"], r["week"]): r["fixed_effects"] for r in narrow.df.collect()}
    assert all(v["indices"] == dummies[k] and v["size"] == len(names) for k, v in vectors.items())


def test_outputs_are_named_by_time_and_reach_a_bucket(spark, monkeypatch):
    from spendlens.sources import writers

    monkeypatch.setattr(writers, "export_results", lambda *a: {"base": a[4], "prefix": a[5]})
    config = {"local": {"enabled": False}, "gcs": {"enabled": True, "bucket": "b", "path": "p/"}}
    found = writers.export_by_config(spark, None, None, None, config)
    assert found["gcs"]["base"] == "gs://b/p" and found["gcs"]["prefix"].startswith("mmm_results_2")
    with pytest.raises(ValueError, match="no bucket"):
        writers.export_by_config(spark, None, None, None, {**config, "gcs": {"enabled": True}})
