import datetime as dt

import pytest

from spendlens.functions import sql_text
from spendlens.functions.columns import channel_of, cost_per_mille, log_plus_one, shorten
from spendlens.functions.promo_text import discount_percent, promo_flags
from spendlens.operators import profile
from spendlens.operators.encode import (
    add_calendar_dummies,
    add_geo_fixed_effects,
    add_sparse_effects,
    add_week_fixed_effects,
    distinct_levels,
)

SHIP, PERCENT, ITEM, BUNDLE, MINIMUM = (
    "free_shipping_promo", "discount_percent_promo", "free_item_promo",
    "bundle_multibuy_promo", "min_purchase_promo",
)
TEXTS = {
    None: (set(), 0),
    "": (set(), 0),
    "-15% i -20%": ({PERCENT}, 15),
    "BEZPŁATNIE": ({ITEM}, 0),
    "BEZPŁATNA WYSYŁKA od 50 zł": ({SHIP, MINIMUM}, 0),
    "kup 2żółte za 1": ({BUNDLE}, 0),
    "2+1 za darmo  produkt": ({BUNDLE, ITEM}, 0),
    "kupujesz raz, drugi tańsza": ({BUNDLE, PERCENT}, 0),
    "Darmowa dostawa": ({SHIP}, 0),
    "za darmo\nwysyłka": ({SHIP}, 0),
    "powyżej 100": ({MINIMUM}, 0),
    "Zamówień POWYŻEJ sto": ({MINIMUM}, 0),
    "rabat 15%": ({PERCENT}, 0),
    "-x%": (set(), 0),
    "discount -5%, free item, komplet za 3 zł": ({PERCENT, ITEM, BUNDLE, MINIMUM}, 5),
}


def test_promo_flags_and_discount(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "promo_description string")
    flags = promo_flags()
    rows = df.select(
        "promo_description", discount_percent().alias("percent"),
        *[c.alias(n) for n, c in flags.items()],
    ).collect()
    for row in rows:
        expected, percent = TEXTS[row["promo_description"]]
        assert {n for n in flags if row[n]} == expected, row
        assert row["percent"] == percent


def test_own_patterns_replace_the_defaults(spark):
    df = spark.createDataFrame([("gratis",), ("Sale",)], "promo_description string")
    flags = promo_flags(patterns={"sale": ["sale"]})
    assert [r[0] for r in df.select(flags["sale"]).collect()] == [0, 1]


def test_expressions(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0), (-1.0, -1000.0), (5.0, 1000.0), (None, None)], "cost double, seen double"
    )
    rows = df.select(log_plus_one("cost"), cost_per_mille("cost", "seen")).collect()
    assert [r[0] for r in rows][:2] == [0.0, None] and rows[3][0] is None
    assert [r[1] for r in rows] == [0.0, None, 2.5, None]
    text = spark.createDataFrame([("x" * 65, "cost_tv_log"), ("ż" * 66, "cost_tv")], "t string, f string")
    rows = text.select(shorten("t"), channel_of("f")).collect()
    assert [tuple(r) for r in rows] == [("x" * 65, "tv"), ("ż" * 65 + "...", "tv")]


def test_sql_text(spark):
    odd = "it's a \\ `name`"
    df = spark.createDataFrame([(odd, 1.5)], "a string, b double").withColumnRenamed("a", odd)
    row = df.selectExpr(
        sql_text.named(f"{sql_text.name(odd)} = {sql_text.literal(odd)}", "same"),
        sql_text.named(sql_text.literal(dt.date(2024, 2, 29)), "day"),
        sql_text.named(sql_text.total([sql_text.literal(float(i)) for i in range(5)]), "sum"),
    ).first()
    assert tuple(row) == (True, dt.date(2024, 2, 29), 10.0)


def test_geo_dummies_in_text_order_and_null(spark):
    df = spark.createDataFrame([("Geo10",), ("Geo2",), ("Geo1",), (None,), ("O'x",)], "geo string")
    got = add_geo_fixed_effects(df)
    assert got.columns == ["geo", "geo_fe_Geo10", "geo_fe_Geo2", "geo_fe_O'x"]
    rows = {r["geo"]: tuple(r)[1:] for r in got.collect()}
    assert rows == {"Geo1": (0, 0, 0), "Geo10": (1, 0, 0), "Geo2": (0, 1, 0), "O'x": (0, 0, 1), None: (0, 0, 0)}


def test_whole_number_geos_are_ordered_as_numbers(spark):
    df = spark.createDataFrame([(10,), (2,), (None,)], "geo int")
    got = add_geo_fixed_effects(df)
    assert got.columns == ["geo", "geo_fe_10"]
    assert {r["geo"]: r["geo_fe_10"] for r in got.collect()} == {10: 1, 2: 0, None: 0}


def test_single_level_gives_no_column(spark):
    df = spark.createDataFrame([("a",), ("a",)], "geo string")
    assert add_geo_fixed_effects(df).columns == ["geo"]


def test_calendar_levels_come_from_the_data(spark):
    weeks = [dt.date(2021, 1, 4), dt.date(2021, 1, 3), dt.date(2020, 12, 28), dt.date(2021, 5, 3)]
    df = spark.createDataFrame([(w,) for w in weeks], "week date")
    got = add_calendar_dummies(df)
    # Isoweeks: 2021-01-03 and 2020-12-28 are week 53, 2021-01-04 is week 1.
    assert got.columns[1:] == ["month_5", "month_12", "quarter_2", "quarter_4", "week_of_year_18", "week_of_year_53"]
    rows = {r["week"]: r for r in got.collect()}
    assert rows[dt.date(2021, 1, 3)]["week_of_year_53"] == 1
    assert rows[dt.date(2021, 1, 4)]["week_of_year_53"] == 0
    assert all(sum(r[c] for c in got.columns if c.startswith("quarter")) <= 1 for r in rows.values())
    assert add_week_fixed_effects(df).columns[1:] == ["week_fe_2021-01-03", "week_fe_2021-01-04", "week_fe_2021-05-03"]


def test_any_number_of_levels(spark):
    df = spark.range(6_000).selectExpr("cast(id as string) as geo")
    assert len(distinct_levels(df, ["geo"])["geo"]) == 6_000
    rows = {r["geo"]: r["fixed_effects"] for r in add_sparse_effects(df, ["geo"]).collect()}
    order = sorted(rows)
    assert rows[order[0]]["indices"] == [] and rows[order[0]]["size"] == 5_999
    assert all(rows[g]["indices"] == [i] and rows[g]["values"] == [1.0] for i, g in enumerate(order[1:]))


PROMO_CASES = [  # text, what it is
    ("Rabat -15% na buty", "discount_percent_promo"),
    ("Darmowa dostawa od dzis", "free_shipping_promo"),
]


def test_literal_promotion_texts(spark):
    df = spark.createDataFrame(PROMO_CASES, "promo_description string, kind string")
    flags = df.select("kind", *[c.alias(n) for n, c in promo_flags().items()]).collect()
    assert all(r[r["kind"]] == 1 for r in flags)


# --- reports on edge cases ---------------------------------------------------------------


@pytest.fixture
def small(spark):
    rows = [
        (dt.date(2022, 1, 3), "a", 1.0, None, 10.0, 3, "Rabat"),
        (dt.date(2022, 1, 3), None, 5.0, 2.0, None, 4, None),
        (dt.date(2022, 1, 10), "a", None, 4.0, 30.0, 5, "free od"),
    ]
    return spark.createDataFrame(
        rows,
        "week date, geo string, cost_tv double, impression_tv double, revenue double, "
        "conversions long, promo_description string",
    )


def test_reports(small):
    assert profile.data_quality(small).first().asDict() == {
        "n_rows": 3, "n_columns": 7, "week_start": "2022-01-03", "week_end": "2022-01-10", "n_geos": 1,
    }
    missing = [tuple(r) for r in profile.missing_report(small).collect()]
    assert missing == [(c, 1, 33.33) for c in ["cost_tv", "geo", "impression_tv", "promo_description", "revenue"]]
    assert tuple(profile.spend_summary(small).first()) == ("tv", 6.0, 3.0, 1.0, 5.0)
    assert tuple(profile.impression_summary(small).first()) == ("tv", 6.0, 3.0)
    assert tuple(profile.kpi_summary(small).first()) == (40.0, 20.0, 10.0, 30.0, 12, 4.0)
    assert list(profile.promo_coverage(small).first())[:3] == [3, 2, 1]
    words = {r["category"]: r["n_promos"] for r in profile.promo_keywords(small).collect()}
    assert words == {"Discount %": 1, "Free Item": 1, "Min Purchase": 1}
    assert [tuple(r) for r in profile.promo_by_geo(small).collect()] == [("a", 2, 2, 100.0)]
    assert [r["sample"] for r in profile.promo_samples(small).collect()] == ["Rabat", "free od"]
    together = profile.data_report(small)
    alone = {
        "missing": profile.missing_report, "spend": profile.spend_summary,
        "impressions": profile.impression_summary, "kpi": profile.kpi_summary,
        "promo_keywords": profile.promo_keywords, "promo_flags": profile.promo_flag_counts,
        "data_quality": profile.data_quality, "promo_coverage": profile.promo_coverage,
        "promo_by_geo": profile.promo_by_geo, "promo_samples": profile.promo_samples,
        "describe": profile.describe_numeric,
    }
    assert set(together) == set(alone)
    for name, report in alone.items():
        assert together[name].columns == report(small).columns
        assert together[name].collect() == report(small).collect(), name


def test_reports_of_no_rows(small):
    empty = small.limit(0)
    for name, table in profile.data_report(empty).items():
        table.collect(), name
    assert profile.missing_report(empty).count() == 0
    assert profile.promo_coverage(empty).first()["promo_pct"] is None
    assert profile.kpi_summary(empty).first()["total_revenue"] is None
    without = empty.drop("promo_description", "revenue", "conversions")
    assert "kpi" not in profile.data_report(without)
    with pytest.raises(ValueError, match="neither revenue nor conversions"):
        profile.kpi_summary(without)
