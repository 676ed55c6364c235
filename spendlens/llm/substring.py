"""Substring removal by suffix automata: words of passages that an earlier document has.

Reference shards are the distinct segments that may repeat (see ``repeats``), a batch of
whole keys each. A task builds the suffix automaton of its shard, every state holding the
least document id among the places where its strings end. Segments then stream
through it: the matching statistic at a word is followed down to the state of the last
``width`` words, and that state's id is the window's first document. The shards are dealt by key
rather than broadcast whole, since they grow with the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.arrow import pieces
from spendlens.llm.repeats import KEY_SEGMENTS, Method, answered, as_words, spans_of, unpacked, with_answers
from spendlens.llm.tables import NO_ID

WIDTH = 13
#: Words of the grams that windows are first filed under.
GRAM = 6


class Automaton:
    """The suffix automaton of several sequences of words."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = [NO_ID]

    def _state(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.least.append(NO_ID)
        return len(self.link) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """The target of ``state`` by ``word`` as a state of its own, one word longer than ``state``."""
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[bytes], number: int) -> None:
        """A sequence, ending at each word in the document ``number``."""
        following, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for word in words:
            target = following[last].get(word)
            if target is not None:
                if length[target] != length[last] + 1:
                    target = self._split(last, word, target)
                last = target
            else:
                new = self._state(length[last] + 1, {}, 0)
                state = last
                while state >= 0 and word not in following[state]:
                    following[state][word] = new
                    state = link[state]
                if state >= 0:
                    target = following[state][word]
                    if length[target] != length[state] + 1:
                        target = self._split(state, word, target)
                    link[new] = target
                last = new
            if number < least[last]:
                least[last] = number

    def finish(self) -> None:
        """A state's strings also end wherever those of the states that link to it do."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if self.least[state] < self.least[up]:
                self.least[up] = self.least[state]

    def first_documents(self, words: list[bytes], width: int) -> list[int]:
        """Per window of the sequence, the least document that has it (``NO_ID``: none)."""
        following, link, length, least = self.next, self.link, self.length, self.least
        out, state, matched = [], 0, 0
        for at, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            state = following[state].get(word, 0)
            matched = matched + 1 if state else 0
            while state and length[link[state]] >= width:
                state = link[state]
                matched = length[state]
            if at + 1 >= width:
                out.append(least[state] if matched >= width else NO_ID)
        return out


def solve(segments: list[bytes], times: np.ndarray, least: np.ndarray, width: int = WIDTH) -> list[bytes]:
    """Per segment, the first document of each of its windows, as 64-bit integers.

    Nothing where the segment occurs once and no window has an earlier document.
    """
    automaton = Automaton()
    split = [s.split(b" ") for s in segments]
    for words, number in zip(split, least.tolist()):
        automaton.add(words, number)
    automaton.finish()
    out = []
    for words, number, n in zip(split, least.tolist(), times.tolist()):
        found = automaton.first_documents(words, width)
        out.append(np.array(found, np.int64).tobytes() if n > 1 or min(found) < number else b"")
    return out


def covered(first: np.ndarray, answers: list[bytes], doc_id: int, n_words: int, width: int) -> np.ndarray:
    """Which words lie in a window whose first document is smaller than ``doc_id``."""
    sizes = np.fromiter(map(len, answers), np.int64, len(answers)) // 8
    ends = np.cumsum(sizes)
    start = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    early = start[np.frombuffer(b"".join(answers), np.int64) < doc_id]
    edge = np.bincount(early, minlength=n_words + 1) - np.bincount(early + width, minlength=n_words + 1)
    return np.cumsum(edge[:n_words]) > 0


def _method(width: int) -> Method:
    return Method(as_words, width, min(GRAM, max(1, width - 1)), False, partial(solve, width=width))


_GAP = re.compile(rb"[\x20\x09-\x0d]+")


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the marked words, each with the white space after it."""
    words, gaps = _GAP.split(text), _GAP.findall(text)
    lead = not words[0]  # the text begins with white space
    out = [gaps[0]] if lead and gaps else []
    for i, drop in enumerate(gone.tolist()):
        if not drop:
            at = i + lead
            out.append(words[at])
            out.append(gaps[at] if at < len(gaps) else b"")
    return b"".join(out)


def _gone(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, bytes, list[bytes], np.ndarray | None]]:
    """(id, text, words, which of them go: None for none) of every row."""
    for doc_id, text, (first, answers) in zip(
        batch.column("doc_id").to_pylist(), unpacked(batch.column("text")), spans_of(batch.column("spans"))
    ):
        words = text.split()
        gone = covered(first, answers, doc_id, len(words), width) if answers else None
        yield doc_id, text, words, gone if gone is not None and gone.any() else None


def removals(docs: DataFrame, width: int = WIDTH, bound: int = KEY_SEGMENTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of (doc_id, text).

    Words are what stands between ASCII white space. A word goes if a window of ``width``
    words that covers it also starts in a document with a smaller id; windows are those of the
    input. A null or empty text has no words. A null id counts as larger than any other. Rows
    that share an id are no earlier documents to each other. ``kept_sha256`` is of the kept
    words joined by one blank; ``rewritten`` gives the texts.
    """
    found = with_answers(docs, answered(docs, _method(width), bound))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for doc_id, _, words, gone in _gone(batch, width):
                kept = words if gone is None else [words[i] for i in np.flatnonzero(~gone).tolist()]
                digest = hashlib.sha256(b" ".join(kept)).hexdigest()
                rows.append((None if doc_id == NO_ID else doc_id, len(words), len(words) - len(kept), digest))
            ids, counts, removed, prints = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(prints)],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def rewritten(docs: DataFrame, width: int = WIDTH, bound: int = KEY_SEGMENTS) -> DataFrame:
    """The rows of ``docs``, all columns, with the removed words taken out of ``text``.

    Texts that lose nothing stay as they are, null included. A column ``n_chars`` follows the text.
    """
    others = F.struct(F.col("text").isNull().alias("text"), *[c for c in docs.columns if c != "text"]).alias("row")
    found = with_answers(docs, answered(docs, _method(width), bound), others)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            new, changed = [], []
            for _, text, _, gone in _gone(batch, width):
                new.append((text if gone is None else without(text, gone)).decode())
                changed.append(gone is not None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(new, pa.string()), pa.array(changed, pa.bool_())],
                ["row", "kept", "changed"],
            )

    rows = found.select("row", "doc_id", "text", "spans")
    schema = T.StructType([rows.schema["row"], T.StructField("kept", T.StringType()), T.StructField("changed", T.BooleanType())])
    columns = []
    for name in docs.columns:
        old = F.col(f"row.`{name}`")
        if name == "text":
            old = F.when(~old, F.col("kept"))
        elif name == "n_chars":
            kind = docs.schema[name].dataType
            old = F.when(F.col("changed"), F.length("kept").cast(kind)).otherwise(old)
        columns.append(old.alias(name))
    return rows.mapInArrow(run, schema).select(*columns)
