"""Language-model scores by online logistic context mixing.

A text is a sequence of tokens: its words, A-Z in lower case, then one end. A frequent word
is a path in a Huffman tree, bit by bit; any other is an escape, followed by its bytes, bit
by bit, where the text itself is coded (bits per byte), or by its share among rare
training words, all unseen words being one type, where tokens are scored as the base does.
Several predictors see the same bit under hashed contexts: the node alone; with the word
before; with the two last common words. A match predictor expects the word that came last
time after the same two words in this text. Their logits are mixed by a weight set that a
gate chooses (depth, match), learnt online, and the mix is refined by an adaptive map from
gate and logit to what bits came out.

The bit counts of each hashed context are gathered from all training documents: every
task fills tables of fixed size, and chunks of these are added up after a shuffle. The mixing
weights and maps are learnt from all training documents too. A hash deals them to units and orders
them there; each unit is gone through online, against tables that leave a document's fold out, and
what the units have learnt is averaged by the bits that each has seen, in exact decimals. So the model does not
depend on how rows lie in partitions. Rows that repeat both id and text share a unit, which streams
them. When texts are scored both stay as they are, so that no row's score depends on other rows scored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.arrow import pieces

#: Words that have a path of their own, at most; those with one occurrence have none.
VOCABULARY = 1 << 18
#: Slots of each hashed table of words, and of letters.
WORD_SLOTS, LETTER_SLOTS = 1 << 20, 1 << 18
#: Words with the lowest numbers (the most frequent ones) that count as common.
COMMON = 96
#: Parts of the training documents; weights are learnt on each against the counts of the others.
FOLDS = 2
#: Text bytes split at a time, tokens coded at a time, entries of a shuffled chunk.
AT_ONCE, TOKENS, CHUNK = 16 << 20, 20_000, 1 << 16
#: Tokens of a unit that is learnt from online; the most units, which are larger beyond that.
UNIT_TOKENS, UNITS = 1 << 20, 10_000
#: Bits of an online step of one weight set.
STEP = 4096
#: Rate of a step, weight of the map's start in bits, count of a slot's start.
RATE, MAP_PRIOR, PRIOR = 0.1, 50.0, 0.4
DEPTHS, BINS, LIMIT = 12, 33, 12.0

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one binary array, and each text's number of them."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column))
    words = parts.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # white space at the ends leaves empty ones
    marks = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    bounds = parts.offsets.to_numpy()
    return words.filter(full).cast(pa.binary()), np.diff(marks[bounds - bounds[0]])


# The code of the words.


@dataclass
class Code:
    """Word i's path: steps[first[i]:first[i + 1]], each a node, its depth and the bit taken there."""

    words: list[bytes]  # by falling frequency; then the escape, then the end
    first: np.ndarray
    #: Node << 5 | depth as far as gates tell it << 1 | bit: one lookup a bit.
    steps: np.ndarray

    def __post_init__(self):
        self.escape, self.end = len(self.words), len(self.words) + 1
        self.n_nodes = len(self.words) + 1

    @property
    def nodes(self) -> np.ndarray:
        return self.steps >> 5

    @property
    def bits(self) -> np.ndarray:
        return (self.steps & 1).astype(np.int8)


def huffman(words: list[bytes], counts: list[int], escapes: int, ends: int) -> Code:
    weights = [*counts, max(1, escapes), max(1, ends)]
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8)
    new = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = new
        side[j] = 1
        heapq.heappush(heap, (a + b, new))
        new += 1
    root = new - 1
    # All words climb at once; a word's path is read backwards.
    at, steps = np.arange(n), []
    while True:
        live = at != root
        if not live.any():
            break
        steps.append((np.flatnonzero(live), parent[at[live]] - n, side[at[live]]))
        at = np.where(live, parent[at], at)
    length = np.zeros(n, np.int64)
    for who, _, _ in steps:
        length[who] += 1
    first = np.concatenate([[0], np.cumsum(length)])
    path = np.zeros(first[-1], np.int32)
    for k, (who, node, bit) in enumerate(steps):
        depth = length[who] - 1 - k
        path[first[who] + depth] = node << 5 | np.minimum(depth, DEPTHS - 1) << 1 | bit
    return Code(words, first, path)


# Bits in their contexts.


@dataclass
class Bits:
    """Coded bits: per predictor the slot in its table, per bit the gate, per token its first bit."""

    bit: np.ndarray
    slots: list[np.ndarray]
    extra: np.ndarray | None  # the match predictor's expectation: -1, 0 or 1
    gate: np.ndarray
    first: np.ndarray


def _slot(context: np.ndarray, place: np.ndarray, slots: int) -> np.ndarray:
    """``context`` is overwritten."""
    context ^= place
    context *= _K[3]
    context >>= np.uint64(64 - (slots.bit_length() - 1))
    return context.view(np.int64)


def word_bits(code: Code, ids: np.ndarray, starts: np.ndarray) -> Bits:
    """Of token numbers; ``starts`` has the first token of each text."""
    n = len(ids)
    place = np.arange(n)
    begin = np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
    before = np.where(place > begin, np.concatenate([[code.end], ids[:-1]]), code.end)
    second = np.where(place > begin + 1, np.concatenate([[code.end] * 2, ids[:-2]])[:n], code.end)
    # The two last common words before each token.
    common = np.where(ids < COMMON, place, -1)
    last = np.maximum.accumulate(np.concatenate([[-1], common[:-1]]))
    kind = np.where(last >= begin, ids[np.maximum(last, 0)], COMMON)
    earlier = np.where(last >= begin, kind[np.maximum(last, 0)], COMMON)
    # What came after the same two words, last time in this text.
    pair = (before.astype(np.uint64) * _K[0] + second.astype(np.uint64) * _K[1]) ^ (begin.astype(np.uint64) * _K[2])
    low = np.uint64(0xFFFFFFFF)
    order = np.sort((pair & ~low) | place.astype(np.uint64))
    same = np.flatnonzero((order[1:] ^ order[:-1]) <= low)
    order = (order & low).astype(np.int64)
    expected = np.full(n, -1)
    expected[order[same + 1]] = ids[order[same]]

    start = code.first[ids]
    size = code.first[ids + 1] - start
    first = np.cumsum(size) - size
    total = int(first[-1] + size[-1]) if n else 0
    at = np.repeat(start - first, size)
    at += np.arange(total)
    steps = code.steps.take(at)
    node, bit = steps >> 5, (steps & 1).astype(np.int8)
    spread = node.astype(np.uint64)
    spread += np.uint64(1)
    spread *= _K[1]
    contexts = [
        before.astype(np.uint64) * _K[0],
        (kind.astype(np.uint64) + np.uint64(3)) * _K[2] + earlier.astype(np.uint64) * _K[0],
    ]
    slots = [node, *(_slot(np.repeat(c, size), spread, WORD_SLOTS) for c in contexts)]
    extra = np.zeros(total, np.int8)
    hoped = np.flatnonzero(expected >= 0)
    if len(hoped):
        # As far as the expected word's path is this word's.
        own = np.repeat(first[hoped], size[hoped])
        step = np.arange(len(own)) - np.repeat(np.cumsum(size[hoped]) - size[hoped], size[hoped])
        word = np.repeat(expected[hoped], size[hoped])
        there = code.first[word] + np.minimum(step, code.first[word + 1] - code.first[word] - 1)
        hope = code.steps[there]
        agrees = hope >> 5 == node[own + step]
        extra[(own + step)[agrees]] = 2 * (hope[agrees] & 1) - 1
    gate = (steps >> 1 & 15).astype(np.uint8)
    gate[extra != 0] += np.uint8(DEPTHS)
    return Bits(bit, slots, extra, gate, first)


def letter_bits(words: pa.Array) -> Bits:
    """Of words spelled byte by byte, a blank at the end of each; a token is a word."""
    words = words.to_pylist()
    data = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)
    n = len(data)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(n) - np.repeat(first, sizes)

    def back(k: int) -> np.ndarray:
        return np.where(place >= k, np.concatenate([np.zeros(k, np.int64), data])[:n], 32)

    a, b, c = back(1), back(2), back(3)
    shift = np.arange(7, -1, -1)
    bit = (data[:, None] >> shift & 1).astype(np.int8).reshape(-1)
    partial = ((data[:, None] | 256) >> (shift + 1)).reshape(-1)  # 1 and the bits so far
    spread = (partial.astype(np.uint64) + np.uint64(1)) * _K[1]
    two = a.astype(np.uint64) * _K[0] + (b.astype(np.uint64) + np.uint64(1)) * _K[2]
    three = two ^ ((c.astype(np.uint64) + np.uint64(9)) * _K[3])
    slots = [np.repeat(a * 256, 8) + partial, *(_slot(np.repeat(x, 8), spread, LETTER_SLOTS) for x in (two, three))]
    gate = np.tile(np.arange(8, dtype=np.uint8), n) + np.repeat((8 * np.minimum(place, 1)).astype(np.uint8), 8)
    return Bits(bit, slots, None, gate, 8 * first)


# Mixing.


@dataclass
class Mixer:
    """Tables of logits, a weight set per gate, and the adaptive map of each gate."""

    tables: list[np.ndarray]
    gates: int
    extra: bool
    weights: np.ndarray = field(default=None)
    refined: np.ndarray = field(default=None)
    seen: np.ndarray = field(default=None)  # bits learnt from, per gate and place of its map

    def __post_init__(self):
        if self.seen is None:
            self.seen = np.zeros((self.gates, BINS), np.int64)
        if self.weights is None:
            k = len(self.tables) + self.extra + 1
            self.weights = np.full((self.gates, k), 0.35, np.float32)
            self.weights[:, -1] = 0.0
            middle = (np.arange(BINS) - BINS // 2) * (2 * LIMIT / (BINS - 1))
            self.refined = np.tile(1 / (1 + np.exp(-middle)), (self.gates, 1)).astype(np.float32)

    def inputs(self, bits: Bits) -> list[np.ndarray]:
        found = [table.take(slots).astype(np.float32, copy=False) for table, slots in zip(self.tables, bits.slots)]
        if self.extra:
            found.append(bits.extra * np.float32(4.0))
        return found

    def _mixed(self, bits: Bits) -> np.ndarray:
        gate = bits.gate.astype(np.intp)
        total = self.weights[:, -1].take(gate)
        for k, (table, slots) in enumerate(zip(self.tables, bits.slots)):
            own = table.take(slots).astype(np.float32, copy=False)
            own *= self.weights[:, k].take(gate)
            total += own
        if self.extra:
            expected = np.flatnonzero(bits.extra)
            weight = self.weights[:, -2].take(gate[expected])
            total[expected] += weight * (bits.extra[expected] * np.float32(4.0))
        return np.clip(total, -LIMIT, LIMIT, out=total)

    @staticmethod
    def _bin(logit: np.ndarray) -> np.ndarray:
        return ((logit + np.float32(LIMIT)) * np.float32((BINS - 1) / (2 * LIMIT)) + np.float32(0.5)).astype(np.int32)

    def learn(self, bits: Bits) -> None:
        """Online: weights by the gradient of steps of ``STEP`` bits, map by what came.

        A weight set changes by the bits of its own gate only, so the gates are gone through one
        by one, the bits of each in their order.
        """
        order = np.argsort(bits.gate, kind="stable")
        ends = np.searchsorted(bits.gate.take(order), np.arange(self.gates, dtype=np.uint8), "right")
        bit = bits.bit.take(order)
        y = bit.astype(np.float32)
        x = np.ones((self.weights.shape[1], len(order)), np.float32)
        for own, values in zip(x, self.inputs(bits)):
            values.take(order, out=own)
        logit = np.empty(len(order), np.float32)
        rate = np.float32(RATE / STEP)
        for gate, end in enumerate(ends):
            weights = self.weights[gate]
            for i in range(ends[gate - 1] if gate else 0, end, STEP):
                part = slice(i, min(i + STEP, end))
                own = x[:, part]
                mixed = np.clip(weights @ own, -LIMIT, LIMIT, out=logit[part])
                weights += rate * (own @ (y[part] - 1 / (1 + np.exp(-mixed))))
        at = self._bin(logit)
        at += np.repeat(np.arange(self.gates, dtype=np.int32) * BINS, np.diff(ends, prepend=0))
        at <<= 1
        at += bit
        zeros, came = np.bincount(at, minlength=2 * self.refined.size).reshape(*self.refined.shape, 2).transpose(2, 0, 1)
        seen = zeros + came
        self.seen += seen
        self.refined += ((came - seen * self.refined) / (self.seen + MAP_PRIOR)).astype(np.float32)

    def log2(self, bits: Bits) -> np.ndarray:
        """Per token, the sum of its bits' log2 probabilities."""
        logit = self._mixed(bits)
        at = self._bin(logit)
        at += bits.gate * np.int32(BINS)
        refined = self.refined.reshape(-1).take(at)
        np.negative(logit, out=logit)
        np.exp(logit, out=logit)
        logit += 1.0
        np.reciprocal(logit, out=logit)
        logit += refined
        logit *= np.float32(0.5)  # the probability that the bit is 1
        p = np.abs((1 - bits.bit) - logit)
        np.maximum(p, np.float32(1e-7), out=p)
        return np.add.reduceat(np.log(p, out=p), bits.first, dtype=np.float64) / np.log(2.0)


# The whole model.


@dataclass
class Model:
    code: Code
    counts: np.ndarray  # of the code's words, the escape (0: unused) and the end, in training tokens
    total: int
    types: int
    single: int  # words that occur once
    words: Mixer | None = None
    letters: Mixer | None = None

    def __post_init__(self):
        self.known = np.log10(self.counts + 1.0)
        self.known[self.code.escape] = 0.0
        # Of the rare tokens: how many, and the share that a new text is taken to have unseen.
        self.rare = max(1, self.total - int(self.counts.sum()))
        self.unseen = (self.single + 1.0) / (self.rare + 2.0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "words_"}

    def vocabulary(self) -> pa.Array:
        if "words_" not in self.__dict__:
            self.words_ = pa.array(self.code.words, pa.binary())
        return self.words_

    def laid_out(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """(token numbers, first token of each text, the words that are escapes), some texts at a time."""
        words, counts = split_words(column)
        found = pc.index_in(words, value_set=self.vocabulary())
        numbers = pc.fill_null(found, self.code.escape).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts)
        tokens = np.insert(numbers, ends, self.code.end)
        after = ends + np.arange(1, len(ends) + 1)
        text = 0
        while text < len(counts):
            begin = after[text - 1] if text else 0
            stop = max(int(np.searchsorted(after, begin + TOKENS, "right")), text + 1)
            own = tokens[begin : after[stop - 1]]
            starts = np.concatenate([[0], after[text : stop - 1] - begin])
            low, high = ends[text] - counts[text], ends[stop - 1]
            rare = words.slice(low, high - low).take(np.flatnonzero(numbers[low:high] == self.code.escape))
            yield own, starts, rare
            text = stop


def _sizes(code: Code) -> list[int]:
    return [code.n_nodes, WORD_SLOTS, WORD_SLOTS, 1 << 16, LETTER_SLOTS, LETTER_SLOTS]


def _fold() -> Column:
    return F.pmod("mark", F.lit(FOLDS)).cast("int")


def _by_fold(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
    folds = batch.column("fold")
    for number in range(FOLDS):
        own = batch.column("text").filter(pc.equal(folds, number))
        if len(own):
            yield number, own


def _gathered(docs: DataFrame, model: Model) -> list[list[np.ndarray]]:
    """The logit tables: bit counts of all texts, per slot, added up chunk by chunk.

    First of all texts, then of all but those of each fold; the latter as float16.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sizes = _sizes(model.code)

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        tables: dict[int, list[np.ndarray]] = {}
        tokens: dict[int, np.ndarray] = {}
        for batch in pieces(batches, limit=AT_ONCE):
            for fold, column in _by_fold(batch):
                if fold not in tables:
                    tables[fold] = [np.zeros(2 * n, np.int32) for n in sizes]
                    tokens[fold] = np.zeros(len(own.counts), np.int32)
                for ids, starts, rare in own.laid_out(column):
                    np.add.at(tokens[fold], ids, np.int32(1))
                    words = word_bits(own.code, ids, starts)
                    spelled = letter_bits(rare) if len(rare) else None
                    # The first table of words follows from the tokens.
                    for at, bits, skip in ((0, words, 1), (3, spelled, 0)):
                        if bits is not None:
                            for k, slots in list(enumerate(bits.slots))[skip:]:
                                place = slots << 1
                                place += bits.bit
                                np.add.at(tables[fold][at + k], place, np.int32(1))
        for fold, n in tokens.items():
            passed = np.repeat(n, np.diff(own.code.first))
            np.add.at(tables[fold][0], 2 * own.code.nodes + own.code.bits, passed)
        press = zstandard.ZstdCompressor(level=1).compress
        for fold, filled in tables.items():
            for k, table in enumerate(filled):
                for i in range(0, len(table), CHUNK):
                    part = table[i : i + CHUNK]
                    if part.any():
                        row = [pa.array([x], pa.int32()) for x in (fold, k, i // CHUNK)]
                        yield pa.RecordBatch.from_arrays(
                            [*row, pa.array([press(part.tobytes())])], ["fold", "number", "chunk", "counts"]
                        )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor().decompress
        sums: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for batch in batches:
            names = ("fold", "number", "chunk", "counts")
            for fold, k, i, raw in zip(*(batch.column(c).to_pylist() for c in names)):
                part = np.frombuffer(loose(raw), np.int32)
                own = sums.setdefault((k, i), {})
                if fold in own:
                    own[fold] += part
                else:
                    own[fold] = part.astype(np.int64)
        for (k, i), own in sums.items():
            whole = sum(own.values())
            for kind, part in enumerate([whole, *(whole - own.get(f, 0) for f in range(FOLDS))]):
                logit = np.log((part[1::2] + PRIOR) / (part[::2] + PRIOR)).astype(np.float16)
                row = [pa.array([x], pa.int32()) for x in (kind, k, i)]
                yield pa.RecordBatch.from_arrays(
                    [*row, pa.array([logit.tobytes()])], ["kind", "number", "chunk", "logits"]
                )

    parts = docs.mapInArrow(fill, "fold int, number int, chunk int, counts binary").repartition("number", "chunk")
    out = [[np.zeros(n, np.float16 if kind else np.float32) for n in sizes] for kind in range(FOLDS + 1)]
    for kind, k, i, raw in parts.mapInArrow(add, "kind int, number int, chunk int, logits binary").toLocalIterator():
        part = np.frombuffer(raw, np.float16)
        out[kind][k][i * CHUNK // 2 : i * CHUNK // 2 + len(part)] = part
    shared.unpersist()
    return out


def _unit_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(unit, rows), cut by the unit's own bytes only; the rows come sorted by unit."""
    held: list[pa.RecordBatch] = []
    size, unit = 0, None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        units = batch.column("unit").to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            if held and units[start] != unit:
                yield unit, whole()
                held, size = [], 0
            unit = int(units[start])
            ends = size + np.cumsum(sizes[start : int(np.searchsorted(units, unit, "right"))], dtype=np.int64)
            n = min(int(np.searchsorted(ends, AT_ONCE)) + 1, len(ends))
            held.append(batch.slice(start, n))
            size = int(ends[n - 1])
            if size >= AT_ONCE:
                yield unit, whole()
                held, size = [], 0
            start += n
    if held:
        yield unit, whole()


def _learn(docs: DataFrame, model: Model, outer: list[list[np.ndarray]]) -> None:
    """The weights and maps of the model's mixers, from all texts: the mean of what the units learn.

    A value counts as often as its unit has seen a bit that teaches it. ``outer`` has the tables
    without each fold; ``docs`` has (text, fold, mark), whose mark deals out and orders the texts.
    """
    # The tables of all texts stay here.
    mixers, model.words, model.letters = (model.words, model.letters), None, None
    shared = docs.sparkSession.sparkContext.broadcast((model, outer))
    model.words, model.letters = mixers
    kinds = [(mixer.gates, mixer.extra) for mixer in mixers]

    def learnt(first: list[Mixer]) -> Iterator[pa.RecordBatch]:
        for number, mixer in enumerate(first):
            by_gate = np.repeat(mixer.seen.sum(axis=1), mixer.weights.shape[1])
            for kind, (values, n) in enumerate(((mixer.weights, by_gate), (mixer.refined, mixer.seen.reshape(-1)))):
                place = np.flatnonzero(n)
                if len(place):
                    value = values.reshape(-1)[place].astype(np.float64) * n[place]
                    row = [pa.array(np.full(len(place), x, np.int32)) for x in (number, kind)]
                    yield pa.RecordBatch.from_arrays(
                        [*row, pa.array(place.astype(np.int32)), pa.array(value), pa.array(n[place])],
                        ["number", "kind", "place", "value", "n"],
                    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = shared.value
        tables = [[table.astype(np.float32) for table in of_fold] for of_fold in tables]
        at, first = None, []
        for unit, batch in _unit_parts(batches):
            if unit != at:
                yield from learnt(first)
                # One set of weights, whatever fold is left out.
                at, first = unit, [Mixer(part, *kind) for part, kind in zip((tables[0][:3], tables[0][3:]), kinds)]
                folds = [
                    [Mixer(part, m.gates, m.extra, m.weights, m.refined, m.seen) for part, m in zip((t[:3], t[3:]), first)]
                    for t in tables
                ]
            for fold, column in _by_fold(batch):
                words, letters = folds[fold]
                for ids, starts, rare in own.laid_out(column):
                    words.learn(word_bits(own.code, ids, starts))
                    if len(rare):
                        letters.learn(letter_bits(rare))
        yield from learnt(first)

    units = min(max(model.total // UNIT_TOKENS, 1), UNITS)
    unit = F.pmod(F.shiftright("mark", 8), F.lit(units)).cast("int")
    dealt = docs.select("text", "fold", "mark", unit.alias("unit")).repartitionById(units, "unit")
    rows = dealt.sortWithinPartitions("unit", "mark", "text").mapInArrow(
        run, "number int, kind int, place int, value double, n long"
    )
    total = F.sum(F.col("value").cast("decimal(28,10)")).cast("double")
    means = rows.groupBy("number", "kind", "place").agg((total / F.sum("n")).alias("mean"))
    for number, kind, place, mean in means.collect():
        values = mixers[number].refined if kind else mixers[number].weights
        values.reshape(-1)[place] = mean
    shared.unpersist()


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all tokens of all texts; the end is the empty word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=8 << 20):
            found = pc.value_counts(split_words(batch.column("text"))[0])
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([b""]), pa.array([batch.num_rows], pa.int64())], ["word", "n"])

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above the least count that leaves ``most`` of them, the most frequent first."""
    step = F.floor(F.log2("n") * 16)
    words = counts.filter(F.octet_length("word") > 0)
    histogram = dict(words.filter("n > 1").groupBy(step.alias("s")).count().collect())
    room, least = most, None
    for s in sorted(histogram, reverse=True):
        room -= histogram[s]
        if room < 0:
            break
        least = s
    if least is None:
        return []
    rows = words.filter("n > 1").filter(step >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda r: (-r[1], r[0]))


def train(docs: DataFrame, counts: DataFrame, vocabulary: int = VOCABULARY) -> Model:
    """The model of (doc_id, text) training rows, whose words ``counts`` has counted.

    An empty table gives a model that knows no word.
    """
    is_end = F.octet_length("word") == 0
    total, ends, types, single = (
        x or 0
        for x in counts.agg(
            F.sum("n"), F.sum(F.when(is_end, F.col("n"))), F.count("*"), F.count_if(~is_end & (F.col("n") == 1))
        ).first()
    )
    frequent = _frequent(counts, vocabulary)
    escapes = total - ends - sum(n for _, n in frequent)
    code = huffman([w for w, _ in frequent], [n for _, n in frequent], escapes, ends)
    model = Model(code, np.array([*(n for _, n in frequent), 0, ends], np.int64), total, types, single)

    marked = docs.select("text", F.xxhash64("doc_id", "text").alias("mark"))
    folded = marked.select("text", "mark", _fold().alias("fold"))
    tables, *outer = _gathered(folded, model)
    model.words = Mixer(tables[:3], 2 * DEPTHS, True)
    model.letters = Mixer(tables[3:], 16, False)
    _learn(folded, model, outer)
    return model


def _rare(docs: DataFrame, counts: DataFrame, shared) -> DataFrame:
    """(doc_id, print, logs, known, seen_logs, unseen): what the words without a path add to a text's scores.

    ``logs`` sums log10(c + 1), ``seen_logs`` log10(c) where c > 0; ``known`` and ``unseen`` count tokens.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.vocabulary()
        for batch in pieces(batches, limit=AT_ONCE):
            words, counts = split_words(batch.column("text"))
            rare = np.flatnonzero(pc.index_in(words, value_set=known).is_null().to_numpy(zero_copy_only=False))
            owner = np.repeat(np.arange(len(counts)), counts)[rare]
            # An empty word for each text that has any: it counts the rows that share an id and a text.
            having = np.unique(owner)
            rows = pa.array(np.concatenate([owner, having]))
            table = pa.Table.from_arrays(
                [rows, pa.concat_arrays([words.take(rare), pa.array([b""] * len(having), pa.binary())])], ["row", "word"]
            )
            table = table.group_by(["row", "word"]).aggregate([([], "count_all")])
            for part in table.to_batches():
                row = part.column("row")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("print").take(row), part.column("word"),
                     part.column("count_all")],
                    ["doc_id", "print", "word", "times"],
                )

    rows = docs.mapInArrow(run, "doc_id long, print long, word binary, times long")
    joined = rows.join(counts, "word", "left")
    row = F.octet_length("word") == 0
    n = F.coalesce("n", F.lit(0))
    repeats = F.sum(F.when(row, F.col("times")))
    return joined.groupBy("doc_id", "print").agg(
        (F.sum(F.when(~row, F.col("times") * F.log10(n + 1.0))) / repeats).alias("logs"),
        (F.sum(F.when(~row & (n > 0), F.col("times")).otherwise(0)) / repeats).cast("long").alias("known"),
        (F.sum(F.when(~row & (n > 0), F.col("times") * F.log10(n))) / repeats).alias("seen_logs"),
        (F.sum(F.when(~row & (n == 0), F.col("times")).otherwise(0)) / repeats).cast("long").alias("unseen"),
    )


def score(docs: DataFrame, held_out: Column, vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    ``docs`` has (doc_id, text); rows where ``held_out`` is not true are learnt from.
    ``base_score`` sums log10((c + 1) / (N + V + 1)) over the tokens, c being a token's count, N
    that of all and V of distinct training tokens. ``score`` is the model's log10
    probability of the same tokens, unseen words being one type as in the base.
    ``bits_per_byte`` is the length of the whole lower-case text's code, unseen words spelled, by
    its bytes (null for none). A null or empty text is one end. Rows that repeat an id are scored each.
    """
    known = docs.select("doc_id", F.xxhash64("text").alias("print"), "text", held_out.alias("held_out"))
    training = known.filter(~F.coalesce("held_out", F.lit(False))).select("doc_id", "text")
    counts = count_words(training).checkpoint()
    model = train(training, counts, vocabulary)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        whole = np.log10(own.total + own.types + 1.0)
        for batch in pieces(batches, limit=AT_ONCE):
            column = batch.column("text")
            parts = []
            for ids, starts, rare in own.laid_out(column):
                logs = own.words.log2(word_bits(own.code, ids, starts))
                tokens = np.add.reduceat(logs, starts)
                if len(rare):
                    logs[np.flatnonzero(ids == own.code.escape)] += own.letters.log2(letter_bits(rare))
                n = np.diff(np.concatenate([starts, [len(ids)]]))
                base = np.add.reduceat(own.known[ids], starts) - n * whole
                seen = np.add.reduceat((own.counts[ids] > 0).astype(np.int64), starts)
                parts.append((n, seen, base, tokens * np.log10(2.0), np.add.reduceat(logs, starts)))
            n, seen, base, tokens, spelled = (np.concatenate(c) for c in zip(*parts))
            sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.float64)
            per_byte = pa.array(-spelled / np.maximum(sizes, 1), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("print"), batch.column("held_out"), pa.array(n),
                 pa.array(seen), pa.array(base), pa.array(tokens), per_byte],
                ["doc_id", "print", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"],
            )

    scored = known.mapInArrow(
        run,
        "doc_id long, print long, held_out boolean, n_tokens long, n_known long, base_score double, "
        "score double, bits_per_byte double",
    )
    rare = _rare(known, counts, shared).withColumnsRenamed({"doc_id": "id", "print": "mark"})
    joined = scored.join(rare, (F.col("doc_id").eqNullSafe(F.col("id"))) & (F.col("print") == F.col("mark")), "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (
            F.col("score")
            + F.coalesce("seen_logs", F.lit(0.0))
            + F.coalesce("known", F.lit(0)) * float(np.log10((1 - model.unseen) / model.rare))
            + F.coalesce("unseen", F.lit(0)) * float(np.log10(model.unseen))
        ).alias("score"),
        "bits_per_byte",
    )
