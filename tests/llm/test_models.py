"""The learnt operators: held-out accuracy, gradients, probabilities, awkward rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import mixing, quality, toxicity
from spendlens.llm.tables import fold
from tests.llm.cases import documents, plain


def labelled(docs, good):
    rows = [(i, int(good(t))) for i, t in plain(docs) if i is not None]
    return docs.sparkSession.createDataFrame(rows, "doc_id long, label int")


# --- toxicity ----------------------------------------------------------------------


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    network = toxicity.Network.new(rng.normal(size=toxicity.GRAM_SLOTS))
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    words = toxicity.slots([b"", b"river", b"stone", b"idiot", b"a"])
    ids = rng.integers(0, 5, (6, toxicity.WINDOW))
    live = (np.arange(toxicity.WINDOW) < rng.integers(3, toxicity.WINDOW, 6)[:, None]).astype(float)
    y = rng.integers(0, 2, 6).astype(float)

    def loss():
        logit = network.forward(network.gates(network.inputs(*words)), ids, live, {})
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    found = network.gradients(words, ids, live, y)
    for name in ("fx", "bh", "fb", "a", "v", "o", "c", "word", "gram"):
        weight = network.weights[name]
        place = np.unravel_index(np.argmax(np.abs(found[name])), weight.shape)
        old, step = weight[place], 1e-4
        weight[place] = old + step
        up = loss()
        weight[place] = old - step
        down = loss()
        weight[place] = old
        assert found[name][place] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-5), name


def test_scan_equals_the_training_pass():
    rng = np.random.default_rng(1)
    network = toxicity.Network.new(rng.normal(size=toxicity.GRAM_SLOTS))
    gates = network.gates(network.inputs(*toxicity.slots([b"", b"river", b"stone", b"road"])))
    ids = rng.integers(0, 4, (9, toxicity.WINDOW))
    live = (np.arange(toxicity.WINDOW) < rng.integers(1, toxicity.WINDOW, 9)[:, None]).astype(np.float32)
    assert network.forward(gates, ids, live) == pytest.approx(network.forward(gates, ids, live, {}), abs=1e-4)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 48, 49, 500])
def test_windows_cover_every_word(n):
    doc, start = toxicity.window_starts(np.array([n, 5]))
    own = start[doc == 0]
    seen = {w for s in own for w in range(s, s + toxicity.WINDOW)}
    assert len(own) >= 1 and set(range(n)) <= seen and (doc == 1).sum() == 1


def test_toxicity_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    held_out = fold("doc_id", 5) == 0
    scored = toxicity.score_toxicity(docs, labels.filter(~held_out), 300)
    rows = scored.filter(held_out).join(labels, "doc_id").collect()
    wrong = [r for r in rows if r["predicted"] != r["label"]]
    assert len(wrong) <= 0.1 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_on_awkward_rows(spark):
    docs = documents(spark)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = labelled(docs, lambda t: b"idiot" in t)
    scored = toxicity.score_toxicity(text, labels, 20)
    assert scored.count() == docs.count() and scored.filter("score is null").count() == 0
    network = toxicity.train([(b"fine text", 0)], (1.0, 0.0))
    assert toxicity.without_toxic(docs, network).count() == docs.count()
    assert toxicity.without_toxic(docs, network).schema == docs.schema
    none = labels.filter("false")
    assert toxicity.score_toxicity(text, none).count() == docs.count()
    assert toxicity.score_toxicity(text.filter("false"), none).collect() == []


# --- quality -----------------------------------------------------------------------


def test_quality_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held_out = fold("doc_id", 3) == 1
    scored = quality.score_quality(docs, labels.filter(~held_out))
    rows = scored.filter(held_out).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["label"] for r in rows) >= 0.95 * len(rows)


def test_quality_density_is_the_gaussian_one(spark):
    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (300, d)), rng.normal(1, 2, (200, d))])
    y = [0] * 300 + [1] * 200
    rows = spark.createDataFrame([(v.tolist(), c) for v, c in zip(x, y)], "x array<double>, label int")
    model = quality.fit(rows.repartition(3), pooled=0.0, diagonal=0.0)
    logs = []
    for c in (0, 1):
        own = x[np.array(y) == c]
        mean, cov = own.mean(0), np.cov(own.T, bias=True)
        gap = x - mean
        far = np.einsum("ni,ij,nj->n", gap, np.linalg.inv(cov), gap)
        logs.append(math.log(len(own) / len(x)) - 0.5 * (far + np.linalg.slogdet(cov)[1]))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), abs=1e-6)


def test_quality_on_awkward_rows(spark):
    docs = documents(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = quality.score_quality(docs, labelled(docs, lambda t: len(t) > 50))
    assert scored.count() == docs.count() and scored.filter("score is null or isnan(score)").count() == 0
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.filter("false"), none).collect() == []


# --- language model ----------------------------------------------------------------


def test_base_scores_are_exact(spark):
    docs = documents(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held_out = lambda i: i is not None and i % 4 == 1
    rows = plain(docs)
    counts, total = Counter(), 0
    for i, t in rows:
        if not held_out(i):
            tokens = [*t.lower().split(), None]
            counts.update(tokens)
            total += len(tokens)
    expected = Counter()
    for i, t in rows:
        tokens = [*t.lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens)
        expected[i, len(tokens), sum(counts[w] > 0 for w in tokens), round(base, 6)] += 1
    for vocabulary in (mixing.VOCABULARY, 3):
        got = mixing.score(docs, F.col("doc_id") % 4 == 1, vocabulary).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == expected
        assert {r["train_tokens"] for r in got} == {total}
        assert all(r["score"] < 0 for r in got)


def test_probabilities_of_the_next_word_add_up_to_one():
    rng = np.random.default_rng(5)
    words = [b"a", b"b", b"c", b"d", b"e"]
    code = mixing.huffman(words, [9, 5, 3, 2, 2], 3, 4)
    sizes = mixing._sizes(code)[:3]
    tables = [rng.normal(0, 1, n).astype(np.float32) for n in sizes]
    mixer = mixing.Mixer(tables, 2 * mixing.DEPTHS, True)
    past = [0, 1, 0, 1]
    total = 0.0
    for word in range(len(words) + 2):
        ids = np.array([*past, word])
        logs = mixer.log2(mixing.word_bits(code, ids, np.array([0])))
        total += 2 ** logs[-1]
    assert total == pytest.approx(1.0, abs=1e-5)


def test_paths_are_prefix_free():
    code = mixing.huffman([bytes([i]) for i in range(40)], list(range(40, 0, -1)), 7, 3)
    paths = {tuple(code.bits[code.first[i] : code.first[i + 1]].tolist()) for i in range(42)}
    assert len(paths) == 42
    assert sum(0.5 ** len(p) for p in paths) == pytest.approx(1.0)
    assert not any(a != b and b[: len(a)] == a for a in paths for b in paths)


def test_model_beats_the_base_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = mixing.score(docs, fold("doc_id", 7) == 2).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows)


@pytest.mark.parametrize("repeats", [300, 30_000])
def test_every_training_document_counts_and_teaches(spark, repeats):
    text = "the river runs down to the sea " * repeats
    for doc_id in range(3):
        docs = spark.createDataFrame([(doc_id, text[:-1])], "doc_id long, text string")
        whole = mixing.train(docs, mixing.count_words(docs))
        assert whole.words.tables[0].any() and whole.words.seen.shape == (2 * mixing.DEPTHS, mixing.BINS)
        fresh = mixing.Mixer(whole.words.tables, 2 * mixing.DEPTHS, True)
        assert (whole.words.weights != fresh.weights).any() and (whole.words.refined != fresh.refined).any()


def test_scores_do_not_depend_on_partitions_or_order(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "UNIT_TOKENS", 4_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.filter("doc_id < 3"))  # rows that repeat
    found = []
    for dealt in (docs.coalesce(1), docs.repartition(7, F.rand(3)).sortWithinPartitions(F.rand(4))):
        rows = mixing.score(dealt, fold("doc_id", 7) == 2).collect()
        found.append(sorted((r["doc_id"], r["n_tokens"], r["score"], r["bits_per_byte"] or 0.0) for r in rows))
    assert len(found[0]) == docs.count()
    for one, other in zip(*found):
        assert one[:2] == other[:2]
        assert one[2:] == pytest.approx(other[2:], rel=1e-9)


def test_units_are_cut_by_their_own_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(mixing, "AT_ONCE", 10)
    units = [0, 0, 0, 0, 2, 2, 3, 3, 3]
    texts = ["abcd", "abcd", "abcd", "x", "a" * 30, None, "", "ab", "abcdefghijk"]
    expected = [(0, texts[:3]), (0, texts[3:4]), (2, texts[4:5]), (2, texts[5:6]), (3, texts[6:])]
    whole = pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(texts)], ["unit", "text"])
    for size in (1, 2, 4, 9):
        batches = [whole.slice(i, size) for i in range(0, 9, size)]
        got = [(unit, part.column("text").to_pylist()) for unit, part in mixing._unit_parts(batches)]
        assert got == expected


def test_learning_goes_through_each_gate_in_order():
    rng = np.random.default_rng(8)
    n, gates = 30_000, 3
    tables = [rng.normal(0, 2, 50), rng.normal(0, 2, 70)]
    slots = [rng.integers(0, len(t), n) for t in tables]
    gate, bit = rng.integers(0, gates, n).astype(np.uint8), rng.integers(0, 2, n).astype(np.int8)
    mixer = mixing.Mixer(tables, gates, False)
    expected, map_ = mixer.weights.astype(np.float64), mixer.refined.astype(np.float64)
    came, seen = np.zeros(map_.shape), np.zeros(map_.shape)
    for g in range(gates):
        own = np.flatnonzero(gate == g)
        for i in range(0, len(own), mixing.STEP):
            step = np.zeros(3)
            for j in own[i : i + mixing.STEP]:
                x = np.array([tables[0][slots[0][j]], tables[1][slots[1][j]], 1.0])
                logit = min(max(float(expected[g] @ x), -mixing.LIMIT), mixing.LIMIT)
                step += (bit[j] - 1 / (1 + np.exp(-logit))) * x
                place = int((logit + mixing.LIMIT) * (mixing.BINS - 1) / (2 * mixing.LIMIT) + 0.5)
                came[g, place] += bit[j]
                seen[g, place] += 1
            expected[g] += mixing.RATE / mixing.STEP * step
    mixer.learn(mixing.Bits(bit, slots, None, gate, np.arange(n)))
    assert mixer.weights == pytest.approx(expected, abs=1e-4)
    assert np.abs(mixer.seen - seen).sum() <= 10  # a logit at a bin's edge may fall either way
    assert mixer.refined == pytest.approx(map_ + (came - seen * map_) / (seen + mixing.MAP_PRIOR), abs=0.02)


def test_words_are_those_between_ascii_white_space():
    import random

    import pyarrow as pa

    rng = random.Random(1)
    texts = ["", " ", " A  b\n", "x\x0by\x0cz\rw\tq ", "é b\x1c\x1fd", "ÄÖ İ K", "\x00 \x85"]
    texts += ["".join(rng.choice(" \n\tabÉ\x0b\x0c\r") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    words, counts = mixing.split_words(pa.array(["q w", *texts]).slice(1))
    expected = [t.encode().lower().split() for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert words.to_pylist() == [w for e in expected for w in e]


def test_empty_corpus(spark):
    none = documents(spark, []).select("doc_id", "text")
    assert mixing.score(none, F.lit(False)).collect() == []
    some = documents(spark, [(1, "all words unseen"), (2, "")]).select("doc_id", "text")
    assert {r["train_tokens"] for r in mixing.score(some, F.lit(True)).collect()} == {0}
