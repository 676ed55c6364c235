import random

from spendlens.llm.topk import quantised, top_k
from tests.llm.cases import sorted_rows


def brute(rows, k):
    import math

    ok = [
        (i, [math.floor(1024 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for own, (q, w) in enumerate(ok):
        if q % 100:
            continue
        found = sorted((-sum(a * b for a, b in zip(w, v)), i) for at, (i, v) in enumerate(ok) if at != own)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank int").repartition(3)


def test_equals_brute_force_with_ties_and_awkward_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(5)]) for i in range(0, 1200, 7)]
    rows += [(100 * i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(1, 9)]
    rows += [
        (9, None), (10, [1.0, None, 0.0, 0.0, 0.0]), (11, [float("nan")] * 5), (12, [float("inf")] * 5),
        (13, []), (None, [1.0] * 5), (14, [2.0]), (77, [0.5] * 5), (77, [0.5] * 5), (500, [0.1] * 5),
    ]
    vectors = quantised(table(spark, [(i, v, 0, 0) for i, v in rows]))
    queries = vectors.filter("vec_id % 100 = 0")
    expected = sorted_rows(brute(rows, 10))
    assert sorted_rows(top_k(vectors, queries).collect()) == expected
    assert sorted_rows(top_k(vectors, queries, block=3).collect()) == expected


def test_rows_that_share_an_id_are_queries_and_candidates_of_their_own(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (200, [2.0, 2.0])]
    rows += [(300, [1.0])] * 15 + [(300, [1.0, 0.0])]
    vectors = quantised(table(spark, [(i, v, 0, 0) for i, v in rows]))
    queries = vectors.filter("vec_id % 100 = 0")
    for k in (1, 3, 10):
        expected = sorted_rows(brute(rows, k))
        assert sorted_rows(top_k(vectors, queries, k).collect()) == expected
        assert sorted_rows(top_k(vectors, queries, k, block=2).collect()) == expected


def test_fewer_candidates_than_k_and_none(spark):
    vectors = quantised(table(spark, [(0, [1.0], 0, 0), (1, [2.0], 0, 0)]))
    queries = vectors.filter("vec_id % 100 = 0")
    assert [tuple(r) for r in top_k(vectors, queries).collect()] == [(0, 1, 1, 1024 * 2048)]
    empty = vectors.filter("false")
    assert top_k(vectors, empty).collect() == [] and top_k(empty, queries).collect() == []


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb

    from spendlens.llm.queries import ORACLE_SQL, QUERIES

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    result = connection.execute(ORACLE_SQL["op6_topk"])
    names = [c[0] for c in result.description]
    expected = sorted_rows(result.fetchall())
    assert sorted_rows(QUERIES["op6_topk"](spark, sf_dir).select(*names).collect()) == expected
