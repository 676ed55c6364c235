import numpy as np
import pytest
import xxhash

from spendlens.llm import simhash
from spendlens.llm.components import components
from tests.llm.cases import documents, plain, sorted_rows


def brute_print(text):
    words = text.lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b, c in enumerate(counts) if 2 * c > len(shingles))


def brute(rows):
    marks = [(i, brute_print(t)) for i, t in rows]
    root = list(range(len(marks)))
    for a in range(len(marks)):
        for b in range(a):
            if bin(marks[a][1] ^ marks[b][1]).count("1") <= 4:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(marks, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f"{p:016x}", least.get(r)) for (i, p), r in zip(marks, root)], list(least.values())


@pytest.mark.parametrize("bound", [simhash.BUCKET_ROWS, 6])
def test_equals_brute_force(spark, bound):
    docs = documents(spark)
    got = simhash.near_duplicates(docs.select("doc_id", "text"), bound=bound).collect()
    assert sorted_rows(got) == sorted_rows(brute(plain(docs))[0])


def test_one_row_of_each_component_stays(spark):
    docs = documents(spark)
    kept = simhash.representatives(docs)
    assert kept.schema == docs.schema
    _, expected = brute(plain(docs))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(expected)


def test_empty_table(spark):
    none = documents(spark, [])
    assert simhash.near_duplicates(none).collect() == [] and simhash.representatives(none).collect() == []


@pytest.mark.parametrize("spread", [64, 12, 5])
def test_index_connects_what_brute_force_connects(spread):
    rng = np.random.default_rng(spread)
    bits = rng.choice(64, spread, replace=False).astype(np.uint64)
    codes = np.unique((rng.integers(0, 2, (300, spread)).astype(np.uint64) << bits).sum(axis=1).astype(np.uint64))
    buckets = np.zeros(len(codes), np.int64)
    index = simhash.GrayIndex(buckets, codes)
    leaf, root = simhash._forest(index, 4)
    label = np.arange(len(codes))
    label[leaf] = root
    near = np.bitwise_count(index.codes[:, None] ^ index.codes) <= 4
    reach = near
    while True:
        more = (reach.astype(int) @ near.astype(int)) > 0
        if (more == reach).all():
            break
        reach = more
    assert ((label[:, None] == label) == reach).all()


def test_gray_rank_orders_the_gray_sequence():
    n = np.arange(1024, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (5, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 99: 99, 100: 99}


@pytest.mark.parametrize("crowd", [simhash.CROWD, 8])
def test_wide_codes_of_a_bucket_are_joined_as_by_brute_force(monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(1)
    made = [rng.integers(0, 2, 128) for _ in range(12)]
    while len(made) < 150:
        code = made[rng.integers(0, len(made))].copy()
        code[rng.choice(128, rng.integers(1, 60), replace=False)] ^= 1
        made.append(code)
    codes = np.packbits(np.array(made, np.uint8), axis=1).view(np.uint64)
    buckets = np.sort(rng.integers(0, 5, len(codes)))
    a, b = simhash._joined(buckets, codes, 40)
    assert (buckets[a] == buckets[b]).all()

    def labels(pairs):
        root = list(range(len(codes)))
        for x, y in pairs:
            old, new = root[x], root[y]
            root = [new if r == old else r for r in root]
        return [root.index(r) for r in root]

    apart = np.bitwise_count(codes[:, None] ^ codes).sum(axis=2)
    assert labels(zip(a, b)) == labels(np.argwhere((apart <= 40) & (buckets[:, None] == buckets)))


def test_tables_are_many_enough():
    rng = np.random.default_rng(2)
    files = simhash.tables(50_000, 0.15)
    lost = [(rng.random(64 * simhash.WIDE) < 0.15)[files].any(axis=1).all() for _ in range(3000)]
    assert files.shape[1] == 10 and sum(lost) <= 3
