import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import repeats, substring, suffixes
from spendlens.llm.repeats import Filter, answered, as_bytes, as_words, runs, with_answers
from tests.llm.cases import documents, plain, sorted_rows

BIG = 1 << 63


def brute_words(rows, width):
    first = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            first[key] = min(first.get(key, BIG), BIG - 1 if i is None else i)
    out = []
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < (BIG - 1 if i is None else i):
                gone[j : j + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(rows, width):
    seen = Counter(t[j : j + width] for _, t in rows for j in range(len(t) - width + 1))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - width + 1):
            if seen[t[j : j + width]] > 1:
                gone[j : j + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("width", "bound"), [(13, 256), (13, 2), (4, 3)])
def test_words_equal_brute_force(spark, width, bound):
    docs = documents(spark)
    got = substring.removals(docs.select("doc_id", "text"), width, bound).collect()
    assert sorted_rows(got) == sorted_rows(brute_words(plain(docs), width))


@pytest.mark.parametrize(("width", "bound"), [(200, 256), (50, 2), (20, 3)])
def test_bytes_equal_brute_force(spark, width, bound):
    docs = documents(spark)
    got = suffixes.removals(docs.select("doc_id", "text"), width, bound).drop("kept").collect()
    assert sorted_rows(got) == sorted_rows(brute_bytes(plain(docs), width))


def test_rewritten_documents_keep_their_columns(spark):
    docs = documents(spark)
    new = substring.rewritten(docs)
    assert new.schema.simpleString() == docs.schema.simpleString()
    lost = {(i, n) for i, _, n, _ in brute_words(plain(docs), 13) if n == 0 and i is not None}
    before, after = dict(plain(docs)), dict(plain(new))
    assert new.count() == docs.count()
    assert all(after[i] == before[i] for i, _ in lost)
    for row in new.filter("doc_id = 201").collect():
        assert row["text"] == "" and row["n_chars"] == 0


def test_empty_tables(spark):
    none = documents(spark, [])
    assert substring.removals(none).collect() == []
    assert substring.rewritten(none).collect() == []
    assert suffixes.removals(none).collect() == []


def test_white_space_after_removed_words_goes_with_them():
    text = b"  one two\nthree  four "
    gone = np.array([False, True, False, True])
    assert substring.without(text, gone) == b"  one three  "


def test_suffix_arrays_find_all_repeats():
    rng = random.Random(3)
    for round_ in range(60):
        width = rng.choice([7, 8, 9, 15, 20])
        segments = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(width, 60))) for _ in range(rng.randint(1, 8))]
        if round_ % 3 == 0:
            segments += [segments[0][: width + 1], b"a" * 50]
        seen = Counter(s[i : i + width] for s in segments for i in range(len(s) - width + 1))
        expected = [[seen[s[i : i + width]] > 1 for i in range(len(s) - width + 1)] for s in segments]
        assert [m.tolist() for m in suffixes.repeated(segments, width)] == expected


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(1, 4, 400), [0]])
    keys = suffixes._packed(text.astype(np.uint64))
    order = suffixes.suffix_array(text, keys, np.arange(len(text), dtype=np.uint64), len(text))
    tails = [text[i:].tolist() for i in order]
    assert tails == sorted(tails)


def test_automaton_knows_the_first_document_of_every_window():
    rng = random.Random(8)
    sequences = [([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 30))], rng.randint(0, 9)) for _ in range(40)]
    machine = substring.Automaton()
    for words, number in sequences:
        machine.add(words, number)
    machine.finish()
    for width in (1, 2, 5):
        first = {}
        for words, number in sequences:
            for i in range(len(words) - width + 1):
                key = tuple(words[i : i + width])
                first[key] = min(number, first.get(key, number))
        probe = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        expected = [first.get(tuple(probe[i : i + width]), substring.NO_ID) for i in range(len(probe) - width + 1)]
        assert machine.first_documents(probe, width) == expected


def test_equal_windows_have_equal_keys():
    passage = b"one two three four five six seven eight nine ten eleven twelve thirteen"
    laid = as_words([b"x y " + passage + b" z", passage.replace(b" ", b"\n"), b"", b"short"])
    found = runs(laid, 13, 5)
    keys = {}
    for key, text, first, n in zip(found.key, found.text, found.first, found.n):
        for i in range(first, first + n):
            keys.setdefault((text, i - laid.first[text]), key)
    assert keys[0, 2] == keys[1, 0] and set(found.text.tolist()) == {0, 1}
    assert len(runs(as_bytes([b"", b"abc"]), 200, 48).key) == 0


def test_filter_holds_its_keys():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, np.uint64)
    bits = np.zeros(1 << 13, np.uint8)
    for place in Filter.places(keys, 1 << 16):
        np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
    made = Filter(bits, 1 << 16)
    assert made.holds(keys).all()
    assert made.holds(keys + np.uint64(1)).mean() < 0.05


def test_repeated_rows_share_the_spans_of_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    for method in (substring._method(13), suffixes._method(20)):
        sizes = []
        for copies in (2, 9):
            rows = [(None, text)] * copies + [(5, text + " more")]
            docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
            found = with_answers(docs, answered(docs, method)).collect()
            assert len(found) == copies + 1
            sizes.append({len(r["spans"]) for r in found if r["doc_id"] != 5 and r["spans"]})
            assert all(len({(x["first"], bytes(x["answer"])) for x in r["spans"]}) == len(r["spans"]) for r in found if r["spans"])
        assert sizes[0] == sizes[1] != set()


def test_filter_reaches_the_driver_in_parts(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS key")
    chunks = repeats._chunks(keys, 1 << 22, 1 << 14).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in chunks.groupBy("part").count().collect()]
    assert sum(sizes) == 256 and max(sizes) <= 4 * repeats.PART_CHUNKS
    known = np.array([r["key"] for r in keys.collect()]).view(np.uint64)
    assert repeats.filter_of(keys, 1 << 22).holds(known).all()
