"""Toxicity: a bidirectional gated recurrent network with attention over words and characters.

A word's input joins a hashed word embedding, the mean of its hashed character n-gram
embeddings, and two log-odds of those n-grams. Two gated recurrent units read each
window of words in both directions, attention pools their states, and a linear layer gives
a logit. All overlapping windows of the whole text are scored; a small logistic model maps
the highest window logit and the number of windows to the document's score.

The network is trained in numpy on a bounded sample of labelled rows (``SAMPLE`` per
class), document labels being handed to windows by repeatedly taking the most suspicious window of each toxic text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.arrow import pieces, texts

#: Labelled ids of each class to learn from, by their hash, among those with a text of so many bytes at most.
SAMPLE, SAMPLE_BYTES = 1500, 100_000
WINDOW, STRIDE = 32, 16
HIDDEN, EMBEDDED, ATTENTION = 8, 6, 8
WORD_SLOTS, GRAM_SLOTS, GRAMS = 1 << 13, 1 << 15, (3, 4, 5)
#: Rounds of choosing windows, steps in each, and windows in a step: the same at any size.
ROUNDS, STEPS, BATCH, RATE = 3, 50, 192, 0.01
#: Words whose inputs a task remembers, windows scored at a time, and words whose n-grams are spread out at a time.
MEMORY, AT_ONCE, SPREAD = 60_000, 2048, 8192
INPUT = 2 * EMBEDDED + 2
_EDGES = b".,;:!?\"'()[]|*%&#$-"


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(_EDGES) for w in text.lower().split()]


_MIX = np.random.default_rng(3).integers(1 << 62, size=max(GRAMS) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's slot, and the slots of its character n-grams with marked ends, cut at the bounds."""
    marked = [f"<{w.decode('utf-8', 'replace')}>  " for w in words]  # two blanks: room for each gram length
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(m) for m in marked])
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(letters)) - 2
    found, owner = [], []
    word = np.repeat(np.arange(len(words)), np.diff(np.concatenate([[0], ends])))
    for n in GRAMS:
        # A word of one or no letter has no gram of its own but the first, blanks included.
        first = np.diff(word, prepend=-1) > 0
        at = np.flatnonzero((left >= n) | (first & (n == GRAMS[0])))
        hashed = sum(letters[at + k] * _MIX[k] for k in range(n)) + _MIX[n]
        found.append(((hashed >> np.uint64(33)) % np.uint64(GRAM_SLOTS)).astype(np.int64))
        owner.append(word[at])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
    return np.array([zlib.crc32(w) % WORD_SLOTS for w in words], np.int64), found[order], bounds


def window_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word in it) of every window; a text without words has one."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(counts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return doc, place * STRIDE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    odds: np.ndarray  # log-odds of the character n-gram slots
    head: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0]))

    @staticmethod
    def new(odds: np.ndarray) -> Network:
        rng = np.random.default_rng(7)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        weights = {"word": draw(WORD_SLOTS, EMBEDDED, scale=0.1), "gram": draw(GRAM_SLOTS, EMBEDDED, scale=0.1)}
        for way in "fb":
            weights |= {
                f"{way}x": draw(INPUT, 3 * HIDDEN, scale=0.3),
                f"{way}h": draw(HIDDEN, 3 * HIDDEN, scale=0.3),
                f"{way}b": np.zeros(3 * HIDDEN, np.float32),
            }
        weights |= {
            "a": draw(2 * HIDDEN, ATTENTION, scale=0.3),
            "v": draw(ATTENTION, scale=0.3),
            "o": draw(2 * HIDDEN, scale=0.3),
            "c": np.zeros(1, np.float32),
        }
        return Network(weights, odds.astype(np.float32))

    def inputs(self, word_slots: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One input row a word; ``grams`` holds the n-gram slots of all, cut at ``bounds``."""
        n = np.diff(bounds)[:, None].astype(np.float32)
        odds = self.odds[grams]
        return np.concatenate(
            [
                self.weights["word"][word_slots],
                np.add.reduceat(self.weights["gram"][grams], bounds[:-1], axis=0) / n,
                np.maximum.reduceat(odds, bounds[:-1])[:, None],
                np.add.reduceat(odds, bounds[:-1])[:, None] / n,
            ],
            axis=1,
        )

    def _read(self, way: str, gates: np.ndarray, ids: np.ndarray, live: np.ndarray, keep: list | None) -> list:
        """The states after each place, in reading order; ``keep`` gets what training needs."""
        u, h = self.weights[f"{way}h"], np.zeros((len(ids), HIDDEN), np.float32)
        states = [None] * WINDOW
        if keep is None:
            return self._scan(way, gates, ids, live, u, h, states)
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            x = gates[ids[:, t]]
            hu = h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = live[:, t, None]
            new = h + m * (1 - z) * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN :], m))
            h = states[t] = new
        return states

    def _scan(self, way, gates, ids, live, u, h, states) -> list:
        """``_read`` without what training needs, on arrays used again at each place."""
        two, whole = 2 * HIDDEN, live.min(axis=0, initial=1.0) > 0
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            x = gates.take(ids[:, t], axis=0)
            hu = h @ u
            zr = x[:, :two]
            zr += hu[:, :two]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1.0
            np.reciprocal(zr, out=zr)
            n = x[:, two:]
            n += zr[:, HIDDEN:] * hu[:, two:]
            np.tanh(n, out=n)
            n -= h
            n *= 1.0 - zr[:, :HIDDEN]
            if not whole[t]:
                n *= live[:, t, None]
            h = states[t] = h + n
        return states

    def forward(self, gates: dict[str, np.ndarray], ids: np.ndarray, live: np.ndarray, keep: dict | None = None):
        """Window logits. ``gates``: the input's share of each direction's gates, a row a word."""
        f = self._read("f", gates["f"], ids, live, None if keep is None else keep.setdefault("f", []))
        b = self._read("b", gates["b"], ids, live, None if keep is None else keep.setdefault("b", []))
        h = np.concatenate([np.stack(f, 1), np.stack(b, 1)], axis=2)
        a = np.tanh(h @ self.weights["a"])
        e = a @ self.weights["v"] + np.where(live > 0, 0, -30).astype(np.float32)
        p = np.exp(e - e.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", p, h)
        if keep is not None:
            keep |= {"h": h, "a": a, "p": p, "pooled": pooled}
        return pooled @ self.weights["o"] + self.weights["c"][0]

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.weights[f"{way}x"] + self.weights[f"{way}b"] for way in "fb"}

    def gradients(self, words: tuple, ids: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss of windows whose labels are y."""
        w = self.weights
        x, keep = self.inputs(*words), {}
        logit = self.forward(self.gates(x), ids, live, keep)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["o"], g["c"] = keep["pooled"].T @ d, np.array([d.sum()])
        h, a, p = keep["h"], keep["a"], keep["p"]
        d_pool = d[:, None] * w["o"]
        d_h = p[:, :, None] * d_pool[:, None]
        d_p = np.einsum("nh,nth->nt", d_pool, h)
        d_e = p * (d_p - (p * d_p).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", d_e, a)
        d_a = d_e[:, :, None] * w["v"] * (1 - a * a)
        g["a"] = np.einsum("nth,nta->ha", h, d_a)
        d_h += d_a @ w["a"].T
        d_x = np.zeros_like(x)
        for way, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, d_next = w[f"{way}h"], np.zeros((len(y), HIDDEN), np.float32)
            d_gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, before, z, r, n, hun, m in reversed(keep[way]):
                d_new = d_next + d_h[:, t, part]
                d_z = d_new * m * (before - n) * z * (1 - z)
                d_n = d_new * m * (1 - z) * (1 - n * n)
                d_r = d_n * hun * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_n], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g[f"{way}h"] += before.T @ d_hu
                np.add.at(d_gates, ids[:, t], d_in)
                d_next = d_new * (1 - m * (1 - z)) + d_hu @ u.T
            g[f"{way}x"], g[f"{way}b"] = x.T @ d_gates, d_gates.sum(axis=0)
            d_x += d_gates @ w[f"{way}x"].T
        word_slots, grams, bounds = words
        n = np.diff(bounds)
        np.add.at(g["word"], word_slots, d_x[:, :EMBEDDED])
        np.add.at(g["gram"], grams, np.repeat(d_x[:, EMBEDDED : 2 * EMBEDDED] / n[:, None], n, axis=0))
        return g

    def document(self, logits: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Features of each document: the best window's logit, the log of their number, 1."""
        n = np.diff(np.concatenate([starts, [len(logits)]]))
        return np.stack([np.maximum.reduceat(logits, starts), np.log(n), np.ones(len(n))], axis=1)


class Lexicon:
    """Words met so far, as numbers; number 0 pads."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]

    def number(self, word: bytes) -> int:
        found = self.numbers.get(word)
        if found is None:
            found = self.numbers[word] = len(self.words)
            self.words.append(word)
        return found


def _laid_out(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers of every window, which of them are words, first window of each document)."""
    counts = np.array([len(d) for d in docs], np.int64)
    flat = np.array([w for d in docs for w in d] + [0] * WINDOW, np.int32)
    first = np.cumsum(counts) - counts
    doc, place = window_starts(counts)
    index = (first[doc] + place)[:, None] + np.arange(WINDOW)
    live = np.arange(WINDOW) + place[:, None] < counts[doc][:, None]
    ids = np.where(live, flat[np.minimum(index, len(flat) - 1)], 0)
    return ids, live.astype(np.float32), np.flatnonzero(place == 0)


def _logits(network: Network, gates: dict[str, np.ndarray], ids: np.ndarray, live: np.ndarray) -> np.ndarray:
    parts = [
        network.forward(gates, ids[i : i + AT_ONCE], live[i : i + AT_ONCE]) for i in range(0, len(ids), AT_ONCE)
    ]
    return np.concatenate(parts)


def _all_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram slots of all words, cut at the bounds, some words at a time."""
    parts = [slots(words[i : i + SPREAD])[1:] for i in range(0, len(words), SPREAD)]
    sizes = np.concatenate([np.diff(bounds) for _, bounds in parts])
    return np.concatenate([grams.astype(np.int32) for grams, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _all_gates(network: Network, words: list[bytes]) -> dict[str, np.ndarray]:
    """The inputs' share of each direction's gates, a row a word, some words at a time."""
    out = {way: np.empty((len(words), 3 * HIDDEN), np.float32) for way in "fb"}
    for i in range(0, len(words), SPREAD):
        for way, rows in network.gates(network.inputs(*slots(words[i : i + SPREAD]))).items():
            out[way][i : i + SPREAD] = rows
    return out


def train(rows: list[tuple[bytes, int]], shares: tuple[float, float]) -> Network:
    """The network for (text, label) rows; ``shares``: of the labels 0 and 1 among all rows.

    Without rows of one label every score is the share of label 1.
    """
    labels = np.array([y for _, y in rows], np.float32)
    if not len(labels) or labels.min() == labels.max():
        network = Network.new(np.zeros(GRAM_SLOTS))
        share = min(max(shares[1], 1e-6), 1 - 1e-6)
        network.head = np.array([0.0, 0.0, np.log(share / (1 - share))])
        return network
    lexicon = Lexicon()
    docs = [[lexicon.number(w) for w in words_of(t)] for t, _ in rows]
    grams, bounds = _all_grams(lexicon.words)
    seen = np.zeros((2, GRAM_SLOTS))
    for numbers, y in zip(docs, labels):
        if numbers:
            own = sorted(set(numbers))
            seen[int(y), np.unique(np.concatenate([grams[bounds[i] : bounds[i + 1]] for i in own]))] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
    rate = np.log((seen + 2.0) / (n + 4.0))
    network = Network.new((rate[1] - rate[0]) / 2.0)

    ids, live, firsts = _laid_out(docs)
    ends = np.concatenate([firsts[1:], [len(ids)]])
    rng = np.random.default_rng(11)
    suspicion = np.maximum.reduceat(network.odds[grams], bounds[:-1])
    del grams, bounds
    level = np.where(live > 0, suspicion[ids], -9).max(axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.weights.items()}
    step = 0
    for _ in range(ROUNDS):
        chosen, targets = [], []
        for a, b, y in zip(firsts, ends, labels):
            chosen.append(a + int(np.argmax(level[a:b])))
            targets.append(y)
            if y == 0 and b - a > 1:
                chosen.append(int(rng.integers(a, b)))
                targets.append(y)
        chosen, targets = np.array(chosen), np.array(targets, np.float32)
        for _ in range(STEPS):
            pick = rng.integers(0, len(chosen), BATCH)
            own, back = np.unique(ids[chosen[pick]], return_inverse=True)
            g = network.gradients(
                slots([lexicon.words[i] for i in own]), back.reshape(-1, WINDOW), live[chosen[pick]], targets[pick]
            )
            step += 1
            for k, v in network.weights.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] * g[k] - s)
                scale = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                v -= (scale * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
        level = _logits(network, _all_gates(network, lexicon.words), ids, live)

    # The document's head, by Newton's method, with the classes in their true shares.
    x = network.document(level, firsts)
    weight = np.where(labels == 1, shares[1] / labels.mean(), shares[0] / (1 - labels.mean()))
    head = np.zeros(3)
    for _ in range(25):
        p = _sigmoid(x @ head)
        slope = x.T @ (weight * (labels - p)) - 1e-2 * head
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        head += np.clip(np.linalg.solve(curve, slope), -2, 2)
    network.head = head
    return network


def learn(docs: DataFrame, training_labels: DataFrame, sample: int = SAMPLE) -> Network:
    """The network of ``sample`` ids per label, those with the least hash, and one text of each.

    They are drawn from the labelled ids that have a text of at most ``SAMPLE_BYTES``; of several such
    texts the one of the least hash teaches. So at most 2 * ``sample`` texts of that size reach the driver,
    however many rows share an id. The label shares are counted over all training rows.
    """
    labels = training_labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    n = dict(labels.groupBy("label").count().collect())
    total = max(1, sum(n.values()))
    short = docs.filter(F.octet_length("text") <= SAMPLE_BYTES).withColumn("print", F.xxhash64("text"))
    teaching = short.select("doc_id", "print").join(labels, "doc_id")
    teaching = teaching.groupBy("doc_id", "label").agg(F.min("print").alias("print"))
    # The ids of the sample first: the texts are then read by a join with few rows.
    order = F.struct(F.xxhash64("doc_id"), "doc_id", "label", "print")
    drawn = [r for y in (0, 1) for r in teaching.filter(F.col("label") == y).orderBy(order).limit(sample).collect()]
    ids = docs.sparkSession.createDataFrame(drawn, teaching.schema)
    rows = short.join(F.broadcast(ids), ["doc_id", "print"]).dropDuplicates(["doc_id", "print", "label"])
    rows = rows.select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    shares = tuple(n.get(y, 0) / total for y in (0, 1))
    return train([(r["text"].encode(), r["label"]) for r in rows], shares)


class _Scorer:
    """Scores texts, remembering the words it has met."""

    def __init__(self, network: Network):
        self.network, self.lexicon, self.held = network, Lexicon(), 0
        self.gates = {way: np.zeros((1024, 3 * HIDDEN), np.float32) for way in "fb"}

    def scores(self, values: list[bytes]) -> np.ndarray:
        if not values:
            return np.zeros(0)
        if len(self.lexicon.words) > MEMORY:
            self.lexicon.clear()
            self.held = 0
        numbers, number = self.lexicon.numbers, self.lexicon.number
        found = [[numbers.get(w) or number(w) for w in words_of(text)] for text in values]
        size, held = len(self.lexicon.words), self.held
        if size > held:
            new = self.network.gates(self.network.inputs(*slots(self.lexicon.words[held:])))
            for way, rows in new.items():
                if size > len(self.gates[way]):
                    more = np.zeros((size, 3 * HIDDEN), np.float32)
                    self.gates[way] = np.concatenate([self.gates[way], more])
                self.gates[way][held:size] = rows
            self.held = size
        ids, live, firsts = _laid_out(found)
        x = self.network.document(_logits(self.network, self.gates, ids, live), firsts)
        return _sigmoid(x @ self.network.head)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, score, predicted) of every row of (doc_id, text), whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in pieces(batches, limit=1 << 20):
            result = scorer.scores(texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(result), pa.array((result >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, network: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose whole text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in pieces(batches, limit=1 << 20):
            yield batch.filter(pa.array(scorer.scores(texts(batch.column("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, training_labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, predicted): how likely each whole text is toxic.

    ``docs`` has (doc_id, text), ``training_labels`` (doc_id, label 0 or 1) of the rows to
    learn from; null labels teach nothing. A text without words is one window of padding and
    gets a score from it. Rows that repeat an id are scored each.
    """
    return score(docs, learn(docs, training_labels, sample))
