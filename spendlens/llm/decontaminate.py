"""Benchmark decontamination: pigeonhole edit matching.

An item within k edits of a passage has at least one of its k + 1 pieces unharmed in it.
One automaton of all pieces finds their exact hits in a document; around each, Myers'
bit-parallel algorithm gives the least edit distance of the whole item to a passage.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.arrow import pieces, texts

#: Edits allowed per byte of a normalised item.
EDIT_RATE = 0.08
#: Bytes of items that one broadcast holds; more items are more passes over the documents.
BLOCK_BYTES = 4 << 20
_PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())

SCHEMA = "doc_id long, item_id long, distance int, n_hits int"


def normalised(text: bytes) -> str:
    """Lower case, without ASCII punctuation, white space as one blank; one character a byte."""
    plain = text.decode().lower().encode().translate(None, _PUNCTUATION)
    return b" ".join(plain.split()).decode("latin-1")


def budget(length: int, rate: float = EDIT_RATE) -> int:
    return int(length * rate)


def cut(item: str, parts: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``parts`` pieces of nearly equal length."""
    ends = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def least_distance(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to a passage of ``text``, by Myers.

    ``masks`` has, per character, the bits of the pattern's places that hold it.
    """
    full, high = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, end = length, 0
    for at, letter in enumerate(text, 1):
        equal = masks.get(letter, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more = down | (full & ~(across | up))
        less = up & across
        if more & high:
            score += 1
        elif less & high:
            score -= 1
            if score < best:
                best, end = score, at
        more = (more << 1) & full
        less = (less << 1) & full
        up = less | (full & ~(vertical | more))
        down = more & vertical
    return best, end


class Matcher:
    """The pieces of items (item_id, normalised text), compiled."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        self.masks: list[dict[str, int] | None] = [None] * len(self.items)
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, text, edits) in enumerate(self.items):
            for offset, piece in cut(text, edits + 1):
                places[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def _masks(self, number: int) -> dict[str, int]:
        masks = self.masks[number]
        if masks is None:
            masks = defaultdict(int)
            for place, letter in enumerate(self.items[number][1]):
                masks[letter] |= 1 << place
            self.masks[number] = masks = dict(masks)
        return masks

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, hits) of every item within its budget of a passage of the text."""
        if not self.items or not text:
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                starts[number].append(end + 1 - length - offset)
        found = []
        for number, hits in starts.items():
            item_id, item, edits = self.items[number]
            hits.sort()
            best, count, at = edits + 1, 0, 0
            while at < len(hits):
                # Hits whose passages may overlap are looked at together, in one bounded stretch.
                first = last = hits[at]
                while at < len(hits) and hits[at] <= last + edits and hits[at] - first <= len(item):
                    last = hits[at]
                    at += 1
                low, high = max(0, first - edits), last + len(item) + edits
                passage = text[low:high]
                if item in passage:
                    distance = 0
                else:
                    distance, _ = least_distance(self._masks(number), len(item), passage)
                if distance <= edits:
                    count += 1
                    best = min(best, distance)
            if count:
                found.append((item_id, best, count))
        return found


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of about ``limit`` bytes, collected one after the other."""
    whole = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = whole.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-size // limit))
    for number in range(n):
        rows = whole.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == number).collect()
        found = {(r["item_id"], r["text"].encode()) for r in rows}
        yield sorted(found, key=lambda item: (item[0] is None, item[0] or 0, item[1]))


def matches(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, n_hits): items found in whole texts of (doc_id, text).

    Both sides are compared in lower case, without ASCII punctuation, white space being one blank. An
    item of n normalised bytes is found where a passage is within floor(rate * n) edits;
    ``distance`` is its least, ``n_hits`` the number of separate stretches with a
    passage. Empty items and empty texts match nothing; two items under one id count
    apart; an item without an id is matched like any other, its ``item_id`` null; a repeated
    document gives its rows again. No match: no row.
    """
    found = None
    for block in _blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast([(i, normalised(t)) for i, t in block])

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in pieces(batches):
                rows = [
                    (doc_id, *match)
                    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")))
                    for match in matcher.find(normalised(text))
                ]
                if rows:
                    doc_ids, item_ids, distances, counts = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), pa.array(item_ids, pa.int64()),
                         pa.array(np.array(distances, np.int32)), pa.array(np.array(counts, np.int32))],
                        ["doc_id", "item_id", "distance", "n_hits"],
                    )

        part = docs.mapInArrow(run, SCHEMA)
        found = part if found is None else found.unionAll(part)
    return found


def clean(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text no item, with an id or without, is found."""
    for block in _blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast([(i, normalised(t)) for i, t in block])

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in pieces(batches):
                kept = [not matcher.find(normalised(text)) for text in texts(batch.column("text"))]
                yield batch.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
