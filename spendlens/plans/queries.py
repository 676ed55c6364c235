"""The registered queries: every operator on the panel derived from the given tables.

Each function takes (spark, sf_dir). The panel and the promotions are persisted once
per folder and session; everything a query does itself is computed anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions import sql_text as sql
from spendlens.functions.columns import (
    has_value,
    iso_week_of,
    log_plus_one,
    month_of,
    quarter_of,
)
from spendlens.functions.promo_text import discount_percent, promo_flags
from spendlens.operators import channels as ch
from spendlens.operators import effects, encode, features, iterative, joins, nulls, profile, regression, returns, series
from spendlens.operators.tables import small_table
from spendlens.plans import jobs, trade_panel
from spendlens.plans.preprocess import Prepared, preprocess, preprocess_summary
from spendlens.session import shared_path
from spendlens.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]

# Settings of the reference run on this panel: its patchy and its empty channel.
PANEL_CONFIG = {
    "fill_columns": [f"impression_{trade_panel.PATCHY_CHANNEL}"],
    "drop_patterns": [trade_panel.EMPTY_CHANNEL],
}
SPEND = [f"cost_{c}" for c in trade_panel.CHANNELS]
SPEND_LOG = [f"{c}_log" for c in SPEND]
DECAY = dict(zip(SPEND, [0.5, 0.3, 0.7, 0.9, 0.0]))
PROMO_MODEL = [
    "cost_high_log",
    "has_promotion",
    "free_shipping_promo",
    "discount_percent_promo",
    "bundle_multibuy_promo",
]
SCENARIO = {"cost_urgent": 1.2, "cost_high": 1.2, "cost_low": 0.8}
SEGMENT_ROWS = 100  # makes the registered segmented variants cut every geo
STORED_BUCKETS = 64  # of the stored series

_cached: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _cached:
        _cached[key] = build(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return _cached[key]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = _once(spark, sf_dir, "base", trade_panel.build_panel)
        return trade_panel.build_full_panel(spark, sf_dir, base, promotions(spark, sf_dir))

    return _once(spark, sf_dir, "panel", build)


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "promotions", trade_panel.build_promotions)


def cost_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).drop("promo_description")


def fanned_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel joined with all promotions: several rows per week and geo."""
    left = cost_revenue(spark, sf_dir)
    return joins.join_promotions(left, promotions(spark, sf_dir))


def _round(column: Column, digits: int) -> Column:
    """Spelled out, since engines round a tie each in their own way."""
    scale = 10.0**digits
    return F.floor(column * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles: sums differ in their last bits with the order of the rows."""
    return df.select(
        *[
            _round(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _metrics(df: DataFrame) -> DataFrame:
    """Metrics rounded by their size: squared errors are the largest numbers here."""
    digits = {"r2": 8, "rmse": 4, "mae": 4, "mse": 0}
    return df.withColumns({c: _round(F.col(c), d) for c, d in digits.items()})


def _money(df: DataFrame) -> DataFrame:
    """Totals in cents, ratios with four decimals."""
    digits = {"coefficient": 4, "total_sales": 2, "total_spend": 2, "mroas": 4}
    return df.withColumns({c: _round(F.col(c), d) for c, d in digits.items()})


def _keyed(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    return rounded(df.select("geo", "week", *columns), digits)


# --- sources and sinks ------------------------------------------------------------


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = writers.write_csv(promotions(spark, sf_dir), shared_path(spark, "scan_csv"))
    return readers.read_csv(spark, stored, "week date, geo string, promo_description string")


def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_table(spark, f"{sf_dir}/customer.parquet")


def import_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs stored as text, promotions in a table of their own."""
    costs = cost_revenue(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in SPEND})
    table = writers.write_parquet(costs, shared_path(spark, "cost_revenue"))
    promos = writers.write_parquet(promotions(spark, sf_dir), shared_path(spark, "promotions"))
    loaded = readers.import_panel(spark, "warehouse", table=table, promotions=promos)
    return _keyed(loaded, [*SPEND, "revenue", "conversions", "promo_description"])


def import_without_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = writers.write_parquet(
        cost_revenue(spark, sf_dir), shared_path(spark, "cost_revenue")
    )
    loaded = readers.import_panel(
        spark, "warehouse", table=table, promotions=shared_path(spark, "nowhere")
    )
    return _keyed(loaded, [*SPEND, "revenue", "conversions"])


def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text, some rows holding a promotion text instead."""
    text = panel(spark, sf_dir).select(
        "geo",
        "week",
        F.coalesce("promo_description", F.col("cost_high").cast("string")).alias("cost_high"),
        F.col("revenue").cast("string").alias("revenue"),
        F.col("conversions").cast("string").alias("conversions"),
        F.col("impression_high").cast("long").cast("string").alias("impression_high"),
    )
    return rounded(readers.coerce_numeric(text))


def parse_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = panel(spark, sf_dir).select(
        "geo", F.date_format("week", "yyyy-MM-dd").alias("week"), "conversions"
    )
    return readers.parse_week(text)


def import_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.import_metadata(panel(spark, sf_dir))


def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = panel(spark, sf_dir)
    path = writers.write_csv(source, shared_path(spark, "sink_csv"))
    return rounded(readers.read_csv(spark, path, source.schema))


def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.write_parquet(panel(spark, sf_dir), shared_path(spark, "sink_parquet"))
    return rounded(readers.read_table(spark, path))


def sink_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.missing_report(panel(spark, sf_dir)).select(
        F.lit("missing").alias("section"),
        F.col("column_name").alias("name"),
        F.col("missing_count").cast("string").alias("value"),
    )
    path = writers.write_results_json(found, shared_path(spark, "results_json"))
    return writers.read_results_json(spark, path)


def model_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = panel(spark, sf_dir)
    model = regression.fit(source, SPEND, "revenue")
    path = writers.save_model(spark, model, shared_path(spark, "model"))
    loaded = writers.load_model(spark, path)
    return _keyed(regression.predict(source, loaded), ["prediction"], 3)


def export_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export all three outputs, then read rows back from each of them."""
    source = panel(spark, sf_dir).select("geo", "week", *SPEND, "revenue")
    model = regression.fit(source, SPEND, "revenue", "ridge")
    results = jobs.results_table(spark, {"model_training": {"model_type": model.model_type}})
    files = writers.export_results(spark, source, model, results, shared_path(spark, "export"))
    table = readers.read_csv(spark, files["processed_data_csv"], source.schema)
    stored = writers.read_results_json(spark, files["results_json"]).first()
    loaded = writers.load_model(spark, files["model_table"])
    scored = regression.predict(table, loaded).withColumn("model_type", F.lit(stored["value"]))
    return _keyed(scored, ["model_type", "prediction"], 3)


# --- channels, nulls, feature selection ---------------------------------------------


def channel_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.channel_table(panel(spark, sf_dir))


def drop_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ch.drop_columns_like(panel(spark, sf_dir), "VOID"))


def drop_empty_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ch.drop_empty_channels(panel(spark, sf_dir)))


def _prepared(spark: SparkSession, sf_dir: str, **changes: object) -> Prepared:
    return preprocess(fanned_out(spark, sf_dir), {**PANEL_CONFIG, **changes})


def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = _prepared(spark, sf_dir)
    return features.feature_set_table(prepared.df, prepared.sets)


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = _prepared(spark, sf_dir)
    names = features.balanced_features(prepared.sets)
    return _keyed(nulls.fill_zero(prepared.df.select("geo", "week", *names)), names)


def fill_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = nulls.fill_zero(panel(spark, sf_dir))
    return _keyed(filled, ["impression_high", "cost_void", "impression_void", "cost_high"])


def median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(nulls.median_fill(panel(spark, sf_dir), "impression_high"), ["impression_high"])


def _directional(method: str, max_rows: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        narrow = panel(spark, sf_dir).select("geo", "week", "impression_high")
        filled = nulls.fill_column(narrow, "impression_high", method, max_rows=max_rows)
        return _keyed(filled, ["impression_high"])

    return query


def model_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        nulls.model_dataset(panel(spark, sf_dir), "revenue", SPEND, ["impression_high"])
    )


def has_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = has_value("promo_description").alias("has_promotion")
    return panel(spark, sf_dir).select("geo", "week", flag)


# --- joins ----------------------------------------------------------------------


def join_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = cost_revenue(spark, sf_dir).select("geo", "week", "revenue")
    return rounded(joins.join_promotions(left, promotions(spark, sf_dir)))


def join_common_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = panel(spark, sf_dir).select("geo", "week", "conversions")
    customers = trade_panel.geo_of_customer(spark, sf_dir).groupBy("geo").agg(
        F.count(F.lit(1)).alias("customers")
    )
    return joins.join_common_columns(left, customers)


# --- reports ----------------------------------------------------------------------


def _report(report: Callable[[DataFrame], DataFrame], source: Query = panel) -> Query:
    return lambda spark, sf_dir: rounded(report(source(spark, sf_dir)))


def data_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report, all promotions included, as rows (section, row_key, name, value)."""
    keys = {
        "missing": "column_name", "spend": "channel", "impressions": "channel",
        "promo_keywords": "category", "promo_flags": "promo_type", "promo_by_geo": "geo",
    }
    rows = None
    for section, table in profile.data_report(fanned_out(spark, sf_dir)).items():
        if section in ("describe", "promo_samples"):
            continue  # registered on their own
        key = keys.get(section)
        cells = [
            F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))
            for c in rounded(table).columns
            if c != key
        ]
        part = rounded(table).select(
            F.lit(section).alias("section"),
            (F.col(key) if key else F.lit("")).alias("row_key"),
            F.inline(F.array(*cells)),
        )
        rows = part if rows is None else rows.unionAll(part)
    number = F.col("value").try_cast("double")
    return rows.select(
        "section",
        "row_key",
        "name",
        number.alias("number"),
        F.when(number.isNull(), F.col("value")).alias("text"),
    )


def preprocess_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess_summary(_prepared(spark, sf_dir))


# --- windows ----------------------------------------------------------------------


def _spend_lags(max_rows: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        narrow = panel(spark, sf_dir).select("geo", "week", *SPEND)
        laid_out = series.as_series(narrow, max_rows=max_rows)
        lagged = features.add_spend_lags(laid_out, SPEND).result()
        return _keyed(lagged, list(features.lag_names(SPEND, [1, 2])))

    return query


def spend_lags_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags on the panel stored in buckets of geo: no shuffle between scan and window."""
    narrow = panel(spark, sf_dir).select("geo", "week", *SPEND)
    path = shared_path(spark, "series")
    name = writers.write_series_table(narrow, path.rsplit("/", 1)[1].replace("-", "_"), path, STORED_BUCKETS)
    lagged = features.add_spend_lags(series.as_series(spark.table(name)), SPEND).result()
    return _keyed(lagged, list(features.lag_names(SPEND, [1, 2])))


def _organic_lag(max_rows: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        narrow = panel(spark, sf_dir).select("geo", "week", "impression_organic")
        laid_out = series.as_series(narrow, max_rows=max_rows)
        lagged = features.add_organic_lag(laid_out).result()
        return _keyed(lagged, ["log_organic", "log_organic_lag1"], 6)

    return query


def _promo_intensity(max_rows: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = fanned_out(spark, sf_dir).select("geo", "week", "promo_description")
        return series.promo_intensity(rows, max_rows=max_rows)

    return query


def adstock(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = panel(spark, sf_dir).select("geo", "week", "cost_high")
    carried = series.adstock(series.as_series(narrow), {"cost_high": 0.5}).result()
    return _keyed(carried, ["cost_high_adstocked"])


def adstock_null_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null in the series and all that follows it become null."""
    narrow = panel(spark, sf_dir).select("geo", "week", "impression_high")
    carried = series.adstock(
        series.as_series(narrow), {"impression_high": 0.4}, null_policy="propagate"
    )
    return _keyed(carried.result(), ["impression_high_adstocked"])


def _adstock_channels(max_rows: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        narrow = panel(spark, sf_dir).select("geo", "week", *SPEND)
        carried = series.adstock_channels(narrow, SPEND, DECAY, max_rows=max_rows)
        return _keyed(carried, [f"{c}_adstocked" for c in SPEND])

    return query


# --- column expressions and encodings ------------------------------------------------


def _columns(build: Callable[[DataFrame], dict[str, Column]], digits: int = 6) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = panel(spark, sf_dir)
        columns = build(source)
        return rounded(
            source.select("geo", "week", *[c.alias(n) for n, c in columns.items()]), digits
        )

    return query


def _log_features(df: DataFrame) -> dict[str, Column]:
    found = ch.discover_channels(df)
    return features.log_columns([*found.cost_columns, *found.impression_columns])


def promo_flags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [c.alias(n) for n, c in promo_flags().items()]
    return promotions(spark, sf_dir).select("geo", "week", "promo_description", *flags)


def discount_percent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotions(spark, sf_dir).select(
        "geo", "week", "promo_description", discount_percent().alias("discount_percent")
    )


def geo_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.add_geo_fixed_effects(panel(spark, sf_dir).select("geo", "week"))


def week_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.add_week_fixed_effects(panel(spark, sf_dir).select("geo", "week"))


def sparse_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector's parts as text, so that any engine compares them alike."""
    rows = encode.add_sparse_effects(panel(spark, sf_dir).select("geo", "week"))
    entries = F.transform("fixed_effects.indices", lambda i: i.cast("string"))
    return rows.select(
        "geo",
        "week",
        F.col("fixed_effects.size").alias("size"),
        F.concat_ws(",", entries).alias("indices"),
        F.aggregate("fixed_effects.values", F.lit(0.0), lambda a, v: a + v).alias("total"),
    )


def _calendar_dummies(part: str) -> Query:
    return lambda spark, sf_dir: encode.add_calendar_dummies(
        panel(spark, sf_dir).select("geo", "week"), [part]
    )


# --- models -----------------------------------------------------------------------


def log_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log spend, promotion features and revenue: what the log models are fitted on."""
    return _logged(panel(spark, sf_dir))


def _logged(source: DataFrame) -> DataFrame:
    return source.withColumns({**features.log_columns(SPEND), **features.promo_columns()})


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["cost_high", "impression_organic", "revenue"]
    scaled = regression.standardize(panel(spark, sf_dir), columns)
    return _keyed(scaled, [f"{c}_std" for c in columns], 6)


def _coefficients(
    model_type: str, names: Sequence[str], alpha: float | None = None, standardized: bool = True
) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = regression.fit(
            panel(spark, sf_dir), names, "revenue", model_type, alpha, standardized
        )
        return rounded(regression.coefficient_table(spark, model))

    return query


def _with_model(
    use: Callable[[DataFrame, regression.LinearModel], DataFrame],
    names: Sequence[str] = SPEND,
    model_type: str = "ols",
    logs: bool = False,
    digits: int | None = 4,
    of: Query = panel,
) -> Query:
    """Fit on the panel (or on its logarithms), then derive a table from the model."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = _logged(of(spark, sf_dir)) if logs else of(spark, sf_dir)
        model = regression.fit(source, names, "revenue", model_type)
        table = use(source, model)
        return table if digits is None else rounded(table, digits)

    return query


def _evaluated(scale: str) -> Callable[[DataFrame, regression.LinearModel], DataFrame]:
    return lambda df, model: _metrics(regression.evaluate(df, model, scale))


def _predicted(scale: str) -> Callable[[DataFrame, regression.LinearModel], DataFrame]:
    return lambda df, model: regression.predict(df, model, scale).select(
        "geo", "week", "prediction"
    )


def evaluate_null_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics where a feature is null in many rows: they are over the complete ones."""
    source = panel(spark, sf_dir)
    names = ["cost_high", "impression_high"]
    model = regression.fit(source, names, "revenue", handle_null="drop")
    return _metrics(regression.evaluate(source, model))


def logistics_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels whose names hold the words that columns are recognised by."""
    named = {
        "cost_high": "cost_logistics", "impression_high": "impression_logistics",
        "cost_low": "cost_low_cost_air", "impression_low": "impression_low_cost_air",
    }
    raw = panel(spark, sf_dir).withColumnsRenamed(named).drop("cost_void", "impression_void")
    found = ch.discover_channels(raw)
    logs = features.log_columns(found.cost_columns)
    model = regression.fit(raw.withColumns(logs), list(logs), "revenue")
    table = _money(returns.marginal_roas(None, model, list(logs), raw))
    per_mille = list(features.cpm_columns(found))
    return table.select(
        "channel", "feature", "total_spend", "mroas", "spend_basis",
        F.concat(F.lit("cpm_"), "channel").isin(per_mille).alias("has_cpm"),
    )


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = panel(spark, sf_dir)
    model = regression.fit(source, SPEND, "revenue")
    rows = regression.model_summary(spark, model, regression.evaluate(source, model))
    number = F.col("value").try_cast("double")
    whole = F.col("name") == "mse"
    few = F.col("section") == "metric"
    return rows.select(
        "section",
        "name",
        F.when(whole, _round(number, 0))
        .when(few, _round(number, 2))
        .otherwise(_round(number, 4))
        .alias("number"),
        F.when(number.isNull(), F.col("value")).alias("text"),
    )


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature table, column by column."""
    return rounded(_prepared(spark, sf_dir).df, 6)


def lags_of_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags where a week has several rows: in the order of the texts, however the rows come."""
    shuffled = fanned_out(spark, sf_dir).repartition(7, F.xxhash64("promo_description", "week"))
    lagged = preprocess(shuffled, {**PANEL_CONFIG, "create_fixed_effects": False}).df
    return _keyed(lagged, ["promo_description", *features.lag_names(SPEND, [1, 2])])


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = regression.compare_models(
        panel(spark, sf_dir), SPEND, "revenue", dict.fromkeys(["ols", "ridge", "lasso"], 1.0)
    )
    return _metrics(table)


def mroas_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No raw spend given: the mean of the logged feature, undone, stands in."""
    source = log_panel(spark, sf_dir)
    model = regression.fit(source, SPEND_LOG, "revenue")
    return _money(returns.marginal_roas(source, model, SPEND_LOG))


def mroas(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = log_panel(spark, sf_dir)
    model = regression.fit(source, SPEND_LOG, "revenue")
    raw = panel(spark, sf_dir).select(*SPEND)
    return _money(returns.marginal_roas(source, model, SPEND_LOG, raw))


def scenario_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = log_panel(spark, sf_dir)
    model = regression.fit(source, SPEND_LOG, "revenue")
    return rounded(returns.scenario_lift(panel(spark, sf_dir), model, SCENARIO))


# --- jobs -------------------------------------------------------------------------


def preprocess_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross-section of the feature table: something of every kind of feature."""
    prepared = _prepared(spark, sf_dir)
    names = [
        "impression_high", "cpm_high", "cost_high_log", "impression_organic_log",
        "has_promotion", "bundle_multibuy_promo", "discount_percent", "promo_intensity",
        "cost_high_lag1", "cost_low_lag2", "month_12", "quarter_4", "week_of_year_30",
        "log_organic", "log_organic_lag1", "market_share", "population",
    ]
    return _keyed(prepared.df, names, 6)


def preprocess_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row sums of the whole feature table by kind of column: nothing is pruned."""
    prepared = _prepared(spark, sf_dir)

    def total(names: Sequence[str]) -> Column:
        return F.expr(sql.total([sql.name(c) for c in names]))

    sets = prepared.sets
    return prepared.df.select(
        "geo",
        "week",
        total(sets["geo_fixed_effects"]).alias("geo_dummies"),
        total(sets["week_fixed_effects"]).alias("week_dummies"),
        total(sets["seasonal_features"]).alias("seasonal_dummies"),
        _round(total(sets["lagged_spend_features"]), 4).alias("lagged"),
        _round(total(sets["spend_features_log"]), 6).alias("logged"),
        total(sets["promotional_features"]).alias("promo_sum"),
    )


def spend_model_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = jobs.fit_spend_model(panel(spark, sf_dir), PANEL_CONFIG)
    job.close()
    return rounded(regression.coefficient_table(spark, job.model))


def full_model_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = jobs.full_analysis(fanned_out(spark, sf_dir), PANEL_CONFIG)
    return _metrics(tables["metrics"])


def full_model_mroas(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = jobs.full_analysis(fanned_out(spark, sf_dir), PANEL_CONFIG)
    return _money(tables["mroas"])


VECTOR_CONFIG = {**PANEL_CONFIG, "fixed_effects_form": "vector"}


def full_model_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full model with its geo effects eliminated, as tables."""
    tables = jobs.full_analysis(fanned_out(spark, sf_dir), VECTOR_CONFIG)
    return _metrics(tables["metrics"])


def full_model_vector_mroas(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = jobs.full_analysis(fanned_out(spark, sf_dir), VECTOR_CONFIG)
    return _money(tables["mroas"])


def _complete_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("geo", *SPEND, "revenue").dropna("any")


def _effects_of(spark: SparkSession, sf_dir: str, model_type: str, alpha: float | None, scale: str) -> DataFrame:
    fitted = effects.fit_effects(_complete_panel(spark, sf_dir), SPEND, "revenue", "geo", model_type, alpha)
    raw = scale == "original"
    slopes = regression.coefficient_table(spark, fitted.model).where("feature <> 'intercept'").select(
        F.col("feature").alias("term"), F.col("coef_raw" if raw else "coef_std").alias("value")
    )
    own = fitted.effects.select(F.concat(F.lit("geo "), "geo"), "effect" if raw else "coefficient")
    return rounded(slopes.union(own), 3 if raw else 6)


def fit_geo_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes and the effect of each geo, by elimination of the geos."""
    return _effects_of(spark, sf_dir, "ols", None, "original")


def fit_geo_effects_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effects_of(spark, sf_dir, "ridge", 50.0, "model")


def fit_sparse_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from sparse vectors of the geos, by conjugate gradients."""
    rows = _complete_panel(spark, sf_dir)
    fitted = iterative.fit_sparse(encode.add_sparse_effects(rows, ["geo"]), SPEND, "revenue")
    index, _ = encode.level_index(rows, "geo")
    named = index.where("place > 0").select(
        (F.col("place") + len(SPEND) - 1).alias("position"), F.concat(F.lit("geo "), "level").alias("term")
    ).union(small_table(spark, list(enumerate(SPEND)), "position long, term string"))
    table = fitted.coefficient_table(rows).join(named, "position")
    return rounded(table.select("term", F.col("coef_raw").alias("value")), 3)


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import from tables, train, evaluate; counts and metrics as rows."""
    table = writers.write_parquet(cost_revenue(spark, sf_dir), shared_path(spark, "cost_revenue"))
    promos = writers.write_parquet(promotions(spark, sf_dir), shared_path(spark, "promotions"))
    config = {
        "data": {"source": "warehouse", "table": table, "promotions": promos},
        "preprocessing": PANEL_CONFIG,
        "model": {"type": "ridge", "alpha": 1.0},
        "output": {
            "local": {"dir": shared_path(spark, "run")},
            "output_prefix": "weekly",
        },
    }
    results = jobs.run(spark, config)
    found = jobs.summary_table(spark, results).where("name not in ('start_time', 'end_time')")
    number = F.col("value").try_cast("double")
    return found.select(
        "section",
        "name",
        _round(number, 4).alias("number"),
        F.when(number.isNull(), F.col("value")).alias("text"),
    )


QUERIES: dict[str, Query] = {
    "build_panel": lambda s, d: rounded(panel(s, d)),
    "build_promotions": promotions,
    "scan_csv": scan_csv,
    "scan_table": scan_table,
    "import_panel": import_panel,
    "import_without_promotions": import_without_promotions,
    "coerce_numeric": coerce_numeric,
    "parse_week": parse_week,
    "import_metadata": import_metadata,
    "sink_csv": sink_csv,
    "sink_parquet": sink_parquet,
    "sink_results_json": sink_results_json,
    "model_table_roundtrip": model_table_roundtrip,
    "export_results": export_results,
    "channel_list": channel_list,
    "drop_channel": drop_channel,
    "drop_empty_channels": drop_empty_channels,
    "feature_sets": feature_sets,
    "feature_matrix": feature_matrix,
    "fill_zero": fill_zero,
    "median_fill": median_fill,
    "ffill_bfill": _directional("ffill", series.MAX_SERIES_ROWS),
    "ffill_bfill_segmented": _directional("ffill", SEGMENT_ROWS),
    "bfill_ffill": _directional("bfill", series.MAX_SERIES_ROWS),
    "bfill_ffill_segmented": _directional("bfill", SEGMENT_ROWS),
    "model_dataset": model_dataset,
    "has_promotion": has_promotion,
    "join_promotions": join_promotions,
    "join_common_columns": join_common_columns,
    "spend_summary": _report(profile.spend_summary),
    "impression_summary": _report(profile.impression_summary),
    "kpi_summary": _report(profile.kpi_summary),
    "missing_report": _report(profile.missing_report),
    "data_quality": _report(profile.data_quality),
    "promo_coverage": _report(profile.promo_coverage, fanned_out),
    "promo_keywords": _report(profile.promo_keywords, fanned_out),
    "promo_by_geo": _report(profile.promo_by_geo, fanned_out),
    "promo_samples": _report(profile.promo_samples, fanned_out),
    "promo_samples_short": _report(
        lambda df: profile.promo_samples(df, n=20, length=12), fanned_out
    ),
    "promo_flag_counts": _report(profile.promo_flag_counts, fanned_out),
    "data_report": data_report,
    "describe_numeric": lambda s, d: profile.describe_numeric(panel(s, d)),
    "preprocess_summary": preprocess_summary_query,
    "spend_lags": _spend_lags(series.MAX_SERIES_ROWS),
    "spend_lags_segmented": _spend_lags(SEGMENT_ROWS),
    "spend_lags_stored": spend_lags_stored,
    "organic_lag": _organic_lag(series.MAX_SERIES_ROWS),
    "organic_lag_segmented": _organic_lag(SEGMENT_ROWS),
    "promo_intensity": _promo_intensity(series.MAX_SERIES_ROWS),
    "promo_intensity_hot_key": _promo_intensity(0),
    "adstock": adstock,
    "adstock_null_poison": adstock_null_poison,
    "adstock_channels": _adstock_channels(series.MAX_SERIES_ROWS),
    "adstock_channels_segmented": _adstock_channels(SEGMENT_ROWS),
    "log_features": _columns(_log_features),
    "log_organic": _columns(lambda df: {"log_organic": log_plus_one("impression_organic")}),
    "cpm": _columns(lambda df: features.cpm_columns(ch.discover_channels(df))),
    "promo_flags": promo_flags_query,
    "discount_percent": discount_percent_query,
    "calendar_parts": _columns(
        lambda df: {
            "month": month_of("week"),
            "quarter": quarter_of("week"),
            "iso_week": iso_week_of("week"),
        }
    ),
    "geo_fixed_effects": geo_fixed_effects,
    "week_fixed_effects": week_fixed_effects,
    "sparse_fixed_effects": sparse_fixed_effects,
    "month_dummies": _calendar_dummies("month"),
    "quarter_dummies": _calendar_dummies("quarter"),
    "week_of_year_dummies": _calendar_dummies("week_of_year"),
    "standardize": standardize,
    "fit_ols_1": _coefficients("ols", ["cost_high"]),
    "fit_ols": _coefficients("ols", SPEND),
    "fit_ols_unscaled": _coefficients("ols", SPEND, standardized=False),
    "fit_ridge_2": _coefficients("ridge", ["cost_high", "cost_low"], 5.0),
    "fit_ridge": _coefficients("ridge", SPEND),
    "fit_ridge_unscaled": _coefficients("ridge", SPEND, standardized=False),
    "fit_lasso_1": _coefficients("lasso", ["cost_high"], 0.1),
    "fit_lasso": _coefficients("lasso", SPEND),
    "fit_lasso_strong": _coefficients("lasso", SPEND, 0.3),
    "coefficients": _with_model(
        lambda df, m: regression.coefficient_table(df.sparkSession, m), SPEND_LOG, logs=True
    ),
    "predict_1": _with_model(_predicted("original"), ["cost_high"], digits=3),
    "predict": _with_model(_predicted("original"), digits=3),
    "predict_model_scale": _with_model(_predicted("model"), digits=6),
    "evaluate_1": _with_model(_evaluated("original"), ["cost_high"], digits=None),
    "evaluate": _with_model(_evaluated("original"), digits=None),
    "evaluate_model_scale": _with_model(_evaluated("model"), digits=None),
    "elasticity_1": _with_model(returns.elasticity, ["cost_high"], digits=6),
    "elasticity": _with_model(returns.elasticity, model_type="ridge", digits=6),
    "elasticity_log": _with_model(
        lambda df, m: returns.log_elasticity(df, m, SPEND_LOG), SPEND_LOG, logs=True, digits=10
    ),
    "contribution_1": _with_model(returns.contribution, ["cost_high"], digits=6),
    "contribution": _with_model(returns.contribution, model_type="ridge", digits=6),
    "contribution_original_scale": _with_model(
        lambda df, m: returns.contribution(df, m, "original"), digits=6
    ),
    "top_elasticity": _with_model(
        lambda df, m: returns.top_elasticity(returns.elasticity(df, m)),
        [*SPEND, "impression_organic"],
        digits=6,
    ),
    "top_contribution": _with_model(
        lambda df, m: returns.top_contribution(returns.contribution(df, m)),
        [*SPEND, "impression_organic"],
        digits=6,
    ),
    "mroas_1": _with_model(
        lambda df, m: _money(returns.marginal_roas(df, m, ["cost_high"], df)),
        ["cost_high"],
        digits=None,
    ),
    "mroas": mroas,
    "mroas_fallback": mroas_fallback,
    "promo_impact": _with_model(
        lambda df, m: returns.promo_impact(
            df, m, ["has_promotion", *features.promo_feature_names()]
        ),
        PROMO_MODEL,
        logs=True,
        of=fanned_out,
    ),
    "scenario_lift": scenario_lift,
    "model_comparison": model_comparison,
    "evaluate_null_features": evaluate_null_features,
    "logistics_channel": logistics_channel,
    "model_summary": model_summary,
    "feature_table": feature_table,
    "lags_of_promotions": lags_of_promotions,
    "preprocess": preprocess_query,
    "preprocess_wide": preprocess_wide,
    "spend_model_job": spend_model_job,
    "full_model_job": full_model_job,
    "full_model_mroas": full_model_mroas,
    "full_model_vector": full_model_vector,
    "full_model_vector_mroas": full_model_vector_mroas,
    "fit_geo_effects": fit_geo_effects,
    "fit_geo_effects_ridge": fit_geo_effects_ridge,
    "fit_sparse_effects": fit_sparse_effects,
    "run_results": run_results,
}
