"""A weekly marketing panel derived from order, line, customer and part tables.

The geo is the customer's nation, the week is the Monday of the order date, and the
order priority plays the media channel: discounts granted are its spend, quantities
its impressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Order priority -> channel name.
CHANNEL_OF_PRIORITY = {
    "1-URGENT": "urgent",
    "2-HIGH": "high",
    "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "unspecified",
    "5-LOW": "low",
}
CHANNELS = list(CHANNEL_OF_PRIORITY.values())
PATCHY_CHANNEL = "high"  # impressions stay null where nothing was sold
EMPTY_CHANNEL = "void"  # both columns entirely null

# Prices and discounts have two decimals, so products have four: rounding a sum to them
# takes away what the order of adding left in the last bits.
MONEY_DIGITS = 4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _discount() -> Column:
    return F.col("l_discount") + F.lit(0.0)  # the data holds -0.0


def geo_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("geo"))
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey", "geo"
    )


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its geo, week and channel."""
    orders = read(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    channel = F.lit(None).cast("string")
    for name, value in CHANNEL_OF_PRIORITY.items():
        channel = F.when(priority == name, value).otherwise(channel)
    week = F.trunc(F.col("o_orderdate").cast("date"), "week")
    return (
        orders.select(
            "o_orderkey", "o_custkey", week.alias("week"), channel.alias("channel")
        )
        .join(
            geo_of_customer(spark, sf_dir).withColumnRenamed("c_custkey", "o_custkey"),
            "o_custkey",
        )
        .select("o_orderkey", "o_custkey", "geo", "week", "channel")
    )


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items summed to one row per order, before any join moves them."""
    gross, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(gross * _discount()).alias("spend"),
            F.sum(quantity).alias("quantity"),
            F.sum(F.when(_discount() < 0.005, quantity)).alias("organic"),
            F.sum(gross * (F.lit(1.0) - _discount())).alias("revenue"),
        )
    )


def build_panel(
    spark: SparkSession, sf_dir: str, geo_column: str = "geo"
) -> DataFrame:
    """The (geo, week) panel, without promotion text.

    ``geo_column="o_custkey"`` gives a much finer panel (one geo per customer) for
    measuring throughput.
    """
    sold = placed_orders(spark, sf_dir).join(order_totals(spark, sf_dir), "o_orderkey")
    sold = sold.withColumn("geo", F.col(geo_column).cast("string"))

    def of(channel: str, value: str) -> Column:
        return F.round(F.sum(F.when(F.col("channel") == channel, F.col(value))), MONEY_DIGITS)

    spend = [F.coalesce(of(c, "spend"), F.lit(0.0)).alias(f"cost_{c}") for c in CHANNELS]
    seen = [
        (
            of(c, "quantity")
            if c == PATCHY_CHANNEL
            else F.coalesce(of(c, "quantity"), F.lit(0.0))
        ).alias(f"impression_{c}")
        for c in CHANNELS
    ]
    panel = sold.groupBy("geo", "week").agg(
        *spend,
        *seen,
        F.coalesce(F.sum("organic"), F.lit(0.0)).alias("impression_organic"),
        F.round(F.sum("revenue"), MONEY_DIGITS).alias("revenue"),
        F.count(F.lit(1)).alias("conversions"),
    )
    return panel.withColumns(
        {
            f"cost_{EMPTY_CHANNEL}": F.lit(None).cast("double"),
            f"impression_{EMPTY_CHANNEL}": F.lit(None).cast("double"),
        }
    )


def build_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (week, geo, promo_description) of deeply discounted lines."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    kind, percent = F.col("p_type"), F.round(_discount() * 100).cast("int")
    text = (
        F.when(
            kind == "PROMO",
            F.concat(
                F.lit("Rabat -"), percent.cast("string"), F.lit("% na "), F.col("p_name")
            ),
        )
        .when(kind == "SMALL", "Darmowa dostawa")
        .when(kind == "LARGE", "Druga sztuka GRATIS")
        .when(kind == "MEDIUM", "Zamówień powyżej 100 zł")
        .when(kind == "ECONOMY", "2żółte za 1")
    )
    deep = (
        read(spark, sf_dir, "lineitem")
        .where(F.col("l_discount") >= 0.085)
        .select("l_orderkey", "l_partkey", "l_discount")
        .join(part, F.col("l_partkey") == part.p_partkey)
        .select(F.col("l_orderkey").alias("o_orderkey"), text.alias("promo_description"))
        .where(F.col("promo_description").isNotNull())
        .distinct()
    )
    return (
        placed_orders(spark, sf_dir)
        .join(deep, "o_orderkey")
        .select("week", "geo", "promo_description")
        .distinct()
    )


def build_cost_revenue(
    spark: SparkSession, sf_dir: str, panel: DataFrame | None = None
) -> DataFrame:
    """The panel with population and market share, still without promotion text.

    Week totals are joined back rather than windowed, so one crowded week is never a
    single task. That reads the panel twice: give a persisted one if it is costly.
    """
    panel = build_panel(spark, sf_dir) if panel is None else panel
    population = geo_of_customer(spark, sf_dir).groupBy("geo").agg(
        F.count(F.lit(1)).alias("population")
    )
    week_total = panel.groupBy("week").agg(
        F.round(F.sum("revenue"), MONEY_DIGITS).alias("week_revenue")
    )
    return (
        panel.join(population, "geo", "left")
        .join(week_total, "week", "left")
        .withColumn("market_share", F.try_divide("revenue", "week_revenue"))
        .drop("week_revenue")
    )


def build_full_panel(
    spark: SparkSession,
    sf_dir: str,
    panel: DataFrame | None = None,
    promotions: DataFrame | None = None,
) -> DataFrame:
    """The panel with one promotion text per (geo, week), null where none ran."""
    promotions = build_promotions(spark, sf_dir) if promotions is None else promotions
    text = promotions.groupBy("week", "geo").agg(
        F.max("promo_description").alias("promo_description")
    )
    costs = build_cost_revenue(spark, sf_dir, panel)
    return costs.join(text, ["week", "geo"], "left")
