"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_RUNS how often each query
runs (the fastest run counts, the JVM being warm then). ``panel_*`` queries read the
weekly panel of nations, persisted beforehand; ``fine_*`` queries the much larger panel
with one geo per customer, ``hot_geo_*`` the same with one geo holding a third of it. ``million_*``
read a parquet table of BENCH_COPIES copies of the fine panel under different geos.
``build_*`` read the raw tables each time.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.operators import profile, regression, series
from spendlens.operators.features import add_spend_lags
from spendlens.operators.joins import join_promotions
from spendlens.plans import jobs, queries, trade_panel
from spendlens.plans.preprocess import preprocess
from spendlens.session import local_session, shared_path
from spendlens.sources.writers import write_parquet

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
COPIES = int(os.environ.get("BENCH_COPIES", "10"))


def drain(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "spendlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spend, config = queries.SPEND, queries.PANEL_CONFIG

    panel = queries.panel(spark, SF_DIR)
    fine = trade_panel.build_panel(spark, SF_DIR, "o_custkey").persist()
    promotions = queries.promotions(spark, SF_DIR)
    # A third of the customers become one geo, too long for one task by this bound.
    hot_rows, order = 10_000, ["week", "customer"]
    is_hot = F.pmod(F.xxhash64("geo"), F.lit(3)) == 0
    hot = fine.withColumn("customer", F.col("geo")).withColumn(
        "geo", F.when(is_hot, "hot").otherwise(F.col("geo"))
    )
    copied = fine.selectExpr("*", f"explode(sequence(1, {COPIES})) AS copy")
    copied = copied.withColumn("geo", F.concat_ws("-", "geo", "copy")).drop("copy")
    million = spark.read.parquet(
        write_parquet(copied.repartition(int(CPUS) * 2), shared_path(spark, "bench"))
    )
    many_geos = {**config, "fixed_effects_form": "vector"}
    rows = {
        "panel": panel.count(),
        "fine": fine.count(),
        "million": million.count(),
        "promotions": promotions.count(),
    }
    lines = queries.trade_panel.read(spark, SF_DIR, "lineitem").count()

    def report() -> None:
        for table in profile.data_report(panel).values():
            drain(table)

    def analysis() -> None:
        for table in jobs.full_analysis(panel, config).values():
            drain(table)

    def full_fit() -> None:
        jobs.fit_full_model(panel, config).close()

    timed: dict[str, Callable[[], object]] = {
        "build_panel": lambda: drain(trade_panel.build_panel(spark, SF_DIR)),
        "build_promotions": lambda: drain(trade_panel.build_promotions(spark, SF_DIR)),
        "panel_join_promotions": lambda: drain(
            join_promotions(queries.cost_revenue(spark, SF_DIR), promotions)
        ),
        "panel_report": report,
        "panel_describe": lambda: drain(profile.describe_numeric(panel)),
        "panel_preprocess": lambda: drain(preprocess(panel, config).df),
        "panel_fit_ols": lambda: regression.fit(panel, spend, "revenue"),
        "panel_fit_full": full_fit,
        "panel_full_analysis": analysis,
        "panel_model_comparison": lambda: drain(
            regression.compare_models(panel, spend, "revenue")
        ),
        "fine_lags": lambda: drain(
            add_spend_lags(series.as_series(fine), spend).result()
        ),
        "fine_adstock": lambda: drain(
            series.adstock_channels(fine, spend, queries.DECAY)
        ),
        "hot_geo_lags": lambda: drain(
            add_spend_lags(series.as_series(hot, order=order, max_rows=hot_rows), spend).result()
        ),
        "hot_geo_adstock": lambda: drain(
            series.adstock_channels(hot, spend, queries.DECAY, order=order, max_rows=hot_rows)
        ),
        "fine_describe": lambda: drain(profile.describe_numeric(fine)),
        "fine_fit_ols": lambda: regression.fit(fine, spend, "revenue"),
        "fine_fit_lasso_12": lambda: regression.fit(
            fine,
            [*spend, *[c for c in fine.columns if c.startswith("impression_") and "void" not in c]],
            "revenue",
            "lasso",
            handle_null="zero",
        ),
    }
    timed.update(
        {
            "million_lags": lambda: drain(
                add_spend_lags(series.as_series(million), spend).result()
            ),
            "million_adstock": lambda: drain(
                series.adstock_channels(million, spend, queries.DECAY)
            ),
            "million_preprocess": lambda: drain(preprocess(million, many_geos).df),
            "million_describe": lambda: drain(profile.describe_numeric(million)),
            "million_spend_summary": lambda: drain(profile.spend_summary(million)),
            "million_fit_ols": lambda: regression.fit(million, spend, "revenue"),
        }
    )
    seconds: dict[str, float] = {}
    for name, run in timed.items():
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "sum of the fastest run of each query",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "rows": {**rows, "lineitem": lines},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
