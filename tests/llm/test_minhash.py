import random
import re

import numpy as np
import pytest

from spendlens.llm import minhash
from spendlens.llm.queries import op12_minhash
from tests.llm.cases import documents, plain
from tests.llm.test_shingles import corpus

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, width=4):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs of sets of word tuples."""
    sets = []
    for _, text in rows:
        words = [w.lower() for w in WORD.findall(text)]
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((i is None, i), least.get(r, (True, None)), key=lambda x: (x[0], x[1] or 0))
    return sorted(
        ((i, len(s), least[r][1], i == least[r][1]) for (i, _), s, r in zip(rows, sets, root)), key=str
    )


def found(frame, **sizes):
    return sorted((tuple(r) for r in minhash.near_duplicates(frame, **sizes).collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"rows": 3, "signature_rows": 2}])
def test_equals_brute_force(spark, sizes):
    docs = corpus(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(frame, **sizes) == brute([(i, (t or "").encode()) for i, t in docs])


def test_chains_of_copies_around_the_least_similarity(spark):
    """Stars do not reach the ends of a chain; the second step has to."""
    rng = random.Random(5)
    rows = []
    for _ in range(8):
        words = [f"v{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(12):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(rng.choice([1, 2, 3])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    rng.shuffle(rows)
    docs = list(enumerate(rows))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute([(i, t.encode()) for i, t in docs])
    assert found(frame) == want
    assert found(frame, rows=2, signature_rows=3) == want


def test_awkward_rows_and_empty_table(spark):
    docs = documents(spark)
    assert found(docs) == brute(plain(docs))
    nothing = minhash.near_duplicates(documents(spark, []))
    assert nothing.collect() == []
    assert nothing.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_minima_estimate_the_similarity():
    rng = np.random.default_rng(2)
    whole = rng.integers(0, 1 << 63, 2000, np.uint64)
    pair = minhash.minima([np.sort(whole[:1800]), np.sort(whole[200:])])
    equal = int((minhash.signatures(pair)[0] == minhash.signatures(pair)[1]).sum())
    assert abs(equal - 160) < 30  # 1,600 of 2,000
    assert len(set(minhash.band_keys(pair)[0].tolist())) == minhash.BANDS


def test_query_on_the_given_documents(spark, sf_dir):
    rows = op12_minhash(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted((tuple(r) for r in rows), key=str) == brute(plain(docs))
