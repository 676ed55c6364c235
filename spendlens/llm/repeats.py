"""Finding where long passages repeat, for the two operators that remove them.

A passage is a run of units (words or bytes), a window ``width`` of them. Each window is
filed under the least hash of its ``gram``-unit grams, so equal windows have equal keys,
and a run of windows with one key is a segment. Keys that occur once cannot hold a
repeat. Of the others, the distinct segments are gathered by key and solved in batches by
the operator's own method; the answers go back to every document that has the segment.

A key with very many distinct segments (a passage in a large part of the corpus, each
time in other surroundings) is filed again under longer grams, up to the window itself,
where one key has one segment. No group is then unbounded, and no window is left out.

The keys that repeat reach the documents as a filter of bounded size (``FILTER_BITS``);
what it lets through in error is a segment without a partner, and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.arrow import pieces, texts
from spendlens.llm.tables import NO_ID
from spendlens.session import shared_path

FILTER_BITS = 1 << 28
CHUNK_BITS = 1 << 20
#: Chunks of the filter that come to the driver at once, about.
PART_CHUNKS = 16
#: Distinct segments of one key above which the key is filed again under longer grams.
KEY_SEGMENTS = 1000
#: Segments that a task solves together, and that it holds to add up equal ones.
BATCH_SEGMENTS, HELD_SEGMENTS = 4000, 100_000
#: Text bytes laid out at a time.
AT_ONCE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(17).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, out=out)


class _Powers:
    """The powers of the base and of its inverse, as far as asked for yet."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """All bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


@dataclass
class Laid:
    """Texts as units: unit i is data[starts[i]:ends[i]], those of text t are first[t] to first[t + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __post_init__(self):
        up, self.down = _POWERS.get(len(self.data) + 1)
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * up[:-1], out=self.sums[1:])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the units from first to last, the ends included, with what stands between them."""
        a = self.starts[first]
        return mixed((self.sums[self.ends[last]] - self.sums[a]) * self.down[a])

    def grams(self, n: int) -> np.ndarray:
        total = len(self.starts) - n + 1
        a = self.starts[:total]
        return mixed((self.sums[self.ends[n - 1 :]] - self.sums[a]) * self.down[a])


def as_words(values: list[bytes]) -> Laid:
    """Words between ASCII white space, one blank between two."""
    data = np.frombuffer(b"\n".join([b"", *values, b""]), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    kept = ~blank
    kept[1:] |= ~blank[:-1]
    text_of = np.cumsum(np.array([1] + [len(v) + 1 for v in values], np.int64))
    plain = np.where(blank, np.uint8(32), data)[kept]
    word = plain != 32
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    old = np.flatnonzero(kept)[starts]
    first = np.searchsorted(old, np.concatenate([text_of[:-1], [len(data)]]))
    return Laid(plain, starts, ends, first)


def as_bytes(values: list[bytes]) -> Laid:
    data = np.frombuffer(b"".join(values), np.uint8)
    starts = np.arange(len(data))
    return Laid(data, starts, starts + 1, np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64))


def _sliding(op: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """op over each n neighbours, by doubling."""
    done = 1
    while 2 * done <= n:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (n - done)], x[n - done :]) if done < n else x


def _least(laid: Laid, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, key of each window, whether the window lies in one text)."""
    if len(laid.starts) < width:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, bool)
    grams = laid.grams(gram)
    keys = _sliding(np.minimum, grams, width - gram + 1)
    sizes = np.diff(laid.first)
    end = np.repeat(laid.first[1:], sizes)
    return grams, keys, np.arange(len(keys)) + width <= end[: len(keys)]


@dataclass
class Runs:
    """Segments: ``n`` windows from unit ``first`` of text ``text``, all under ``key``."""

    key: np.ndarray
    text: np.ndarray
    first: np.ndarray
    n: np.ndarray


def runs(laid: Laid, width: int, gram: int) -> Runs:
    """The segments of the texts, none longer than the grams of a window are many.

    ``width`` is 2 at least, so that a window across two texts stands between theirs.
    """
    _, keys, valid = _least(laid, width, gram)
    longest = width - gram + 1
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (keys[1:] != keys[:-1])
    begin = np.flatnonzero(head)
    last = np.flatnonzero(valid & np.concatenate([~valid[1:] | head[1:], [True]])[: len(valid)])
    size = last - begin + 1
    parts = -(-size // longest)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(begin, parts) + place * longest
    n = np.minimum(np.repeat(last + 1, parts) - first, longest)
    text = np.searchsorted(laid.first, first, "right") - 1
    return Runs(keys[first] if len(first) else np.zeros(0, np.uint64), text, first, n)


def key_places(laid: Laid, width: int, gram: int) -> np.ndarray:
    """The key of every place whose gram is the least of some window: a window that
    repeats, within a text too, makes its key come at two places."""
    grams, keys, valid = _least(laid, width, gram)
    n = width - gram + 1
    if not len(keys):
        return grams
    # A place counts if the largest key of the windows around it is its own hash.
    shown = np.where(valid, keys, np.uint64(0))
    edge = np.zeros(n - 1, np.uint64)
    around = _sliding(np.maximum, np.concatenate([edge, shown, edge]), n)
    return grams[(around == grams) & (grams > 0)]


class Filter:
    """Which keys may repeat: two bits of a fixed-size map each."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @staticmethod
    def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return (keys % np.uint64(size)).astype(np.int64), (
            (keys * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)) % np.uint64(size)
        ).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for place in self.places(keys, self.size):
            out &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _chunks(keys: DataFrame, size: int, chunk: int) -> DataFrame:
    """(chunk, bits): the chunks of the filter that have any bit set."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(Filter.places(own, size)))], ["place"])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            place = np.unique(batch.column("place").to_numpy(zero_copy_only=False))
            for number in np.unique(place // chunk).tolist():
                own = place[place // chunk == number] % chunk
                bits = maps.setdefault(number, np.zeros(chunk // 8, np.uint8))
                np.bitwise_or.at(bits, own >> 3, (1 << (own & 7)).astype(np.uint8))
        for number, bits in maps.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["chunk", "bits"]
            )

    places = keys.mapInArrow(spread, "place long")
    # So many partitions that one holds little of the filter: they come to the driver one by one, and are not merged.
    dealt = places.repartition(max(1, size // (PART_CHUNKS * chunk)), F.expr(f"place div {chunk}"))
    return dealt.mapInArrow(fill, "chunk long, bits binary")


def filter_of(keys: DataFrame, size: int = FILTER_BITS) -> Filter:
    """The filter of the keys in a (key long) frame; ``size / 8`` bytes at most reach the driver, part by part."""
    chunk = min(CHUNK_BITS, size)
    out = np.zeros(size // 8, np.uint8)
    for row in _chunks(keys, size, chunk).toLocalIterator():
        at = row["chunk"] * chunk // 8
        out[at : at + chunk // 8] |= np.frombuffer(row["bits"], np.uint8)
    return Filter(out, size)


@dataclass(frozen=True)
class Method:
    """How an operator sees texts and solves a batch of distinct segments.

    ``solve`` takes segments in the order of their keys, with the number of their
    occurrences and the least id among them; it returns one binary answer for each, an
    empty one if there is nothing to say.
    """

    lay: Callable[[list[bytes]], Laid]
    width: int
    gram: int
    within: bool  # repeats inside one text count too
    solve: Callable[[list[bytes], np.ndarray, np.ndarray], list[bytes]]


def _identified(docs: DataFrame, *others: Column) -> DataFrame:
    """(doc_id, print, text): a text is known by its id and its hash, so rows that share an id do not mix."""
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        *others,
    )
    return named.withColumn("print", F.xxhash64("text"))


def _segment(laid: Laid, raw: bytes, run: Runs, i: int, width: int) -> bytes:
    return raw[laid.starts[run.first[i]] : laid.ends[run.first[i] + run.n[i] + width - 2]]


def _repeated_keys(docs: DataFrame, method: Method) -> DataFrame:
    """(key) of every key under which two windows may be equal."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=AT_ONCE):
            laid = method.lay(texts(batch.column("text")))
            if method.within:
                key, n = np.unique(key_places(laid, method.width, method.gram), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])
            else:
                found = runs(laid, method.width, method.gram)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[found.text]
                order = np.lexsort((ids, found.key))
                key, ids = found.key[order], ids[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])[: len(key)]
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(ids[new])], ["key", "id"])

    if method.within:
        counted = docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        return counted.filter("n > 1").select("key")
    ends = docs.mapInArrow(run, "key long, id long").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    return ends.filter("a < b").select("key")


def _filed(batches: Iterable[pa.RecordBatch], method: Method, chosen: Filter) -> Iterator[tuple]:
    """Per piece: its layout, the segments under keys of the filter, their marks, and ids of their texts."""
    for batch in pieces(batches, limit=AT_ONCE):
        laid = method.lay(texts(batch.column("text")))
        found = runs(laid, method.width, method.gram)
        keep = chosen.holds(found.key)
        found = Runs(found.key[keep], found.text[keep], found.first[keep], found.n[keep])
        if len(found.key):
            mark = laid.hashes(found.first, found.first + found.n + method.width - 2).view(np.int64)
            yield batch, laid, found, mark, batch.column("doc_id").to_numpy(zero_copy_only=False)[found.text]


def _places(docs: DataFrame, method: Method, shared) -> DataFrame:
    """(key, mark, doc_id, print, first): where each segment under a key of the filter stands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, laid, found, mark, ids in _filed(batches, method, shared.value):
            prints = batch.column("print").to_numpy(zero_copy_only=False)[found.text]
            first = (found.first - laid.first[found.text]).astype(np.int32)
            columns = (found.key.view(np.int64), mark, ids, prints, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], ["key", "mark", "doc_id", "print", "first"]
            )

    return docs.mapInArrow(run, "key long, mark long, doc_id long, print long, first int")


_SEGMENTS = "key long, mark long, least long, times long, segment binary"


def _segments(docs: DataFrame, method: Method, shared) -> DataFrame:
    """The segments under keys of the filter, those of several pieces that are equal as one row:
    the least id and how often it occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def rows() -> pa.RecordBatch:
            columns = zip(*((k, m, least, times, segment) for (k, m), (least, times, segment) in held.items()))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.binary()])],
                ["key", "mark", "least", "times", "segment"],
            )

        for _, laid, found, mark, ids in _filed(batches, method, shared.value):
            key = found.key.view(np.int64)
            order = np.lexsort((ids, mark, key))
            k, m = key[order], mark[order]
            heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])]))
            times = np.diff(np.concatenate([heads, [len(k)]]))
            lead = order[heads]
            raw = laid.data.tobytes()
            a, b = laid.starts[found.first[lead]], laid.ends[found.first[lead] + found.n[lead] + method.width - 2]
            for name, least, n, i, j in zip(
                zip(k[heads].tolist(), m[heads].tolist()), ids[lead].tolist(), times.tolist(), a.tolist(), b.tolist()
            ):
                known = held.get(name)
                if known is None:
                    held[name] = [least, n, raw[i:j]]
                else:
                    known[0] = min(known[0], least)
                    known[1] += n
            if len(held) >= HELD_SEGMENTS:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return docs.mapInArrow(run, _SEGMENTS)


_REFILED = "key long, mark long, whole_key long, whole_mark long, offset int, least long, times long, segment binary"


def _refiled(rows: DataFrame, method: Method, gram: int) -> DataFrame:
    """Segments cut under keys of longer grams; ``whole_key``, ``whole_mark`` and ``offset`` say of what."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "segment", AT_ONCE):
            laid = method.lay(texts(batch.column("segment")))
            found = runs(laid, method.width, gram)
            raw = laid.data.tobytes()
            mark = laid.hashes(found.first, found.first + found.n + method.width - 2).view(np.int64)
            old = {
                c: batch.column(c).to_numpy(zero_copy_only=False)[found.text]
                for c in ("whole_key", "whole_mark", "offset", "least", "times")
            }
            old["offset"] = (old["offset"] + found.first - laid.first[found.text]).astype(np.int32)
            segments = [_segment(laid, raw, found, i, method.width) for i in range(len(mark))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.key.view(np.int64)), pa.array(mark), *(pa.array(c) for c in old.values()),
                 pa.array(segments, pa.binary())],
                ["key", "mark", *old, "segment"],
            )

    return rows.mapInArrow(run, _REFILED)


def _solved(segments: DataFrame, method: Method, bound: int, label: str) -> DataFrame:
    """(key, mark, answer) of the segments, and those of crowded keys as they are, in a written table.

    Rows of one segment are added up on the way. Keys come sorted, whole keys are solved
    in batches, and no more than ``bound`` segments of a key are held: beyond, they are passed
    on (answer null). Segments that share nothing with others have no row.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(key, mark, answer, least, times, segment) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            columns = (key, mark, answer, least, times, segment)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["key", "mark", "answer", "least", "times", "segment"],
            )

        def solved(ready: list[list]) -> pa.RecordBatch:
            keys, marks, least, times, segments = zip(*ready)
            answers = method.solve(list(segments), np.array(times), np.array(least))
            kept = [i for i, a in enumerate(answers) if a]
            none = [None] * len(kept)
            return written([keys[i] for i in kept], [marks[i] for i in kept], [answers[i] for i in kept], none, none, none)

        def passed(rows: list[list]) -> pa.RecordBatch:
            keys, marks, least, times, segments = zip(*rows)
            return written(keys, marks, [None] * len(rows), least, times, segments)

        ready: list[list] = []  # of whole keys
        own: list[list] = []  # of the key at hand
        crowded = False
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "mark", "least", "times", "segment"))):
                if own and own[-1][0] == row[0]:
                    if own[-1][1] == row[1]:
                        own[-1][2] = min(own[-1][2], row[2])
                        own[-1][3] += row[3]
                        continue
                    if len(own) >= bound:
                        crowded = True
                        yield passed(own)
                        own = []
                elif own:
                    if crowded:
                        yield passed(own)
                    else:
                        ready += own
                    own, crowded = [], False
                    if len(ready) >= BATCH_SEGMENTS:
                        yield solved(ready)
                        ready = []
                own.append(list(row))
        if own:
            if crowded:
                yield passed(own)
            else:
                ready += own
        if ready:
            yield solved(ready)

    dealt = segments.repartition("key").sortWithinPartitions("key", "mark")
    path = shared_path(segments.sparkSession, label)
    schema = "key long, mark long, answer binary, least long, times long, segment binary"
    dealt.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return segments.sparkSession.read.schema(schema).parquet(path)


def _all_answers(segments: DataFrame, method: Method, bound: int) -> DataFrame:
    """(key, mark, offset, answer): what is known of each segment from its unit ``offset`` on."""
    spark = segments.sparkSession
    table = _solved(segments, method, bound, "segments")
    parts = [table.filter("answer IS NOT NULL").selectExpr("key", "mark", "0 AS offset", "answer")]
    left = table.filter("segment IS NOT NULL")
    rows = left.selectExpr("key AS whole_key", "mark AS whole_mark", "0 AS offset", "least", "times", "segment")
    gram = method.gram
    while gram < method.width and not left.isEmpty():
        # Half as many grams in a window each time; the last one is the window.
        gram = method.width - (method.width - gram) // 2
        path = shared_path(spark, "refiled")
        _refiled(rows, method, gram).write.option("compression", "zstd").parquet(path)
        rows = spark.read.schema(_REFILED).parquet(path)
        own = rows.groupBy("key", "mark").agg(
            F.min("least").alias("least"), F.sum("times").alias("times"), F.first("segment").alias("segment")
        )
        # Under a gram as long as the window a key has one segment, but for chance.
        table = _solved(own, method, bound if gram < method.width else 1 << 40, "segments")
        parts.append(
            rows.select("key", "mark", "whole_key", "whole_mark", "offset")
            .join(table.filter("answer IS NOT NULL").select("key", "mark", "answer"), ["key", "mark"])
            .selectExpr("whole_key AS key", "whole_mark AS mark", "offset", "answer")
        )
        left = table.filter("segment IS NOT NULL")
        rows = rows.join(left.select("key").distinct(), "key", "left_semi").drop("key", "mark")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def answered(docs: DataFrame, method: Method, bound: int = KEY_SEGMENTS, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, print, first, answer): the answers of a text's segments that may repeat.

    ``docs`` has (doc_id, text). ``first`` is the unit at which the answer starts. A text
    is known by its id (a null one as ``NO_ID``) and ``print``, its hash.
    """
    known = _identified(docs)
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(_repeated_keys(known, method), bits))
    answers = _all_answers(_segments(known, method, shared), method, bound)
    found = _places(known, method, shared).join(answers, ["key", "mark"])
    return found.select("doc_id", "print", (F.col("first") + F.col("offset")).alias("first"), "answer")


def packed(docs: DataFrame) -> DataFrame:
    """``text`` compressed, for a shuffle."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches):
            small = [press(text) for text in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(small)], [*others, "text"])

    return docs.mapInArrow(run, docs.select(*others).schema.add("text", "binary"))


def unpacked(column: pa.Array) -> list[bytes]:
    """The texts that ``packed`` has compressed."""
    loose = zstandard.ZstdDecompressor().decompress
    return [loose(value) for value in column.to_pylist()]


def spans_of(column: pa.ListArray) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Per row of ``spans``: the units at which its answers start, and the answers; none for null."""
    bounds = column.offsets.to_numpy()
    inner = column.values.slice(bounds[0], bounds[-1] - bounds[0])
    first = inner.field("first").to_numpy(zero_copy_only=False)
    answers = inner.field("answer").to_pylist()
    bounds = (bounds - bounds[0]).tolist()
    for a, b in zip(bounds, bounds[1:]):
        yield first[a:b], answers[a:b]


def with_answers(docs: DataFrame, found: DataFrame, *others: Column) -> DataFrame:
    """(doc_id, text, spans array<struct<first, answer>>, others...) of every row of ``docs``.

    No answers: null. Rows that repeat an id and a text share the spans of one of them, each span
    once, however many rows there are. ``others`` are columns of ``docs`` to carry along; the text comes ``packed``.
    """
    spans = found.groupBy("doc_id", "print").agg(F.collect_set(F.struct("first", "answer")).alias("spans"))
    small = packed(_identified(docs, *others))
    return small.join(spans.hint("shuffle_hash"), ["doc_id", "print"], "left").drop("print")
