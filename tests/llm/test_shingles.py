import random
import time
from pathlib import Path

import pytest

import corpus_pipeline
from spendlens.llm import shingles, simhash
from spendlens.session import free_shuffles
from tests.llm.cases import documents


def brute(rows):
    def of(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [of(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    return sorted(least.values())


def corpus(seed, families=6, copies=14):
    """Chains of variants, each a few words away from an earlier one, around the least similarity."""
    rng = random.Random(seed)
    rows = []
    for family in range(families):
        made = [[f"w{family}x{rng.randrange(400)}" for _ in range(rng.choice([8, 90, 200]))]]
        for _ in range(copies):
            words = list(rng.choice(made))
            for _ in range(max(1, len(words) * rng.choice([1, 2, 3, 4]) // 100)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            made.append(words)
        rows += [" ".join(words) for words in made]
    rng.shuffle(rows)
    return list(enumerate([*rows, "", None, " ", "one two", "One  two"]))


@pytest.mark.parametrize("rows", [shingles.BLOCK_ROWS, 4])
def test_equals_brute_force(spark, rows):
    docs = corpus(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = [r["doc_id"] for r in shingles.representatives(frame, rows=rows).collect()]
    assert sorted(kept) == brute(docs)


def test_stage_joins_documents_of_least_similarity(spark):
    words = [f"word{i}" for i in range(104)]
    other = [*words[:50], "new", *words[51:80], "more", *words[81:]]  # 90 of 110 shingles: 0.818
    unlike = [*words[:20], "a", *words[21:50], "b", *words[51:80], "c", *words[81:]]  # 85 of 115: 0.739
    docs = spark.createDataFrame(
        [(1, " ".join(words)), (2, " ".join(other))] + [(3, " ".join(unlike))], "doc_id long, text string"
    )
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.filter("doc_id != 3"), "").collect()
    assert [r["doc_id"] for r in kept] == [1]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.filter("doc_id != 2"), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]


def test_all_columns_and_empty_table(spark):
    docs = documents(spark)
    assert shingles.representatives(docs).schema == docs.schema
    assert shingles.representatives(documents(spark, [])).collect() == []


def test_candidates_are_links_of_fingerprints(spark, monkeypatch):
    words = [f"word{i}" for i in range(100)]
    near = [(i, " ".join([*words[:i], "new", *words[i + 1 :]])) for i in range(1, 9)]
    docs = spark.createDataFrame(near, "doc_id long, text string")
    calls = []

    def nothing(codes, distance, differ):
        calls.append((distance, codes.count()))
        return simhash.wide_links(codes, 0, differ).limit(0)

    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [1]
    monkeypatch.setattr(shingles, "wide_links", nothing)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert len(kept) == 8 and calls == [(shingles.DISTANCE, 8)]


def test_links_of_fingerprints_hold_pairs_of_least_similarity(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        text = [f"x{rng.randrange(10**9)}" for _ in range(84)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text, *(f"y{rng.randrange(10**9)}" for _ in range(20))]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")  # 80 of 100 shingles
    assert sorted(r["doc_id"] for r in shingles.representatives(frame).collect()) == list(range(0, 800, 2))


def fingerprinted(spark, texts):
    frame = spark.createDataFrame([(i, i, text) for i, text in enumerate(texts)], "id long, print long, text string")
    return shingles._marked(frame.repartition(3), shingles.WIDTH).select("code", "fp").checkpoint()


def test_texts_without_a_common_shingle_are_no_candidates(spark):
    """Chance pairs, of short texts above all, would chain the corpus to one candidate component."""
    rng = random.Random(7)
    texts = [" ".join(f"x{rng.randrange(10**9)}" for _ in range(rng.choice([6, 8, 10, 40]))) for _ in range(3000)]
    links = simhash.wide_links(fingerprinted(spark, texts), shingles.DISTANCE, shingles.DIFFER)
    assert links.count() < 100


def test_tables_a_few_at_a_time_give_the_same(spark, monkeypatch):
    docs = corpus(4)
    monkeypatch.setattr(simhash, "TABLES_AT_ONCE", 3)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingles.representatives(frame).collect()) == brute(docs)


def test_family_of_like_texts_is_not_sent_in_squares(spark, monkeypatch):
    """520 texts that are candidates of one another, most of them not similar to the least: each is sent once."""
    rng = random.Random(9)
    base, texts = [f"w{i}" for i in range(150)], []
    for _ in range(520):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(150)] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    sent, solved = [], shingles._solved

    def noted(groups):
        sent.append(groups.count())
        return solved(groups)

    monkeypatch.setattr(shingles, "_solved", noted)
    docs = list(enumerate(texts))
    kept = shingles.representatives(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == brute(docs)
    assert sum(sent) <= len(texts)


def test_shuffle_files_go_before_the_next_step(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    kept = spark.range(1000).repartition(3, "id").checkpoint()
    made = files() - before
    assert made
    free_shuffles(spark)
    for _ in range(50):
        if not made & files():
            break
        time.sleep(0.1)
    assert not made & files() and kept.count() == 1000
