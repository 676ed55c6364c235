"""Every registered query against its SQL on the generated tables."""

import pytest

from spendlens.plans.oracle import ORACLE_SQL
from spendlens.plans.queries import QUERIES
from tests.compare import compare, open_tables


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = open_tables(sf_dir)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_sql(name, spark, sf_dir, tables):
    assert compare(QUERIES[name](spark, sf_dir), tables, ORACLE_SQL[name]) is None


def test_panel_matches_measured_totals(spark, sf_dir):
    from pyspark.sql import functions as F

    if not sf_dir.endswith("sf0.01"):
        pytest.skip("totals are known for sf0.01")
    row = QUERIES["build_panel"](spark, sf_dir).agg(
        F.count("*"),
        F.count_if(F.isnull("impression_high")),
        F.count_if(F.col("cost_urgent") == 0),
        F.round(F.sum("revenue"), 2),
        F.round(F.sum("cost_high"), 2),
        F.sum("conversions"),
    ).first()
    assert tuple(row) == (7011, 4531, 4540, 3024008727.89, 32142703.36, 14743)
