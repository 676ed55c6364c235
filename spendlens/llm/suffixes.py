"""Repeated byte strings by suffix arrays, built by two-stage sorting.

A task joins a batch of segments that may repeat (see ``repeats``) into one text. Only the suffixes
smaller than their successors are sorted directly; one scan over the buckets of first
bytes, from the least on, then induces the order of the others, each from its successor's
place. Common prefixes of neighbours in the order, as far as ``width`` bytes, tell which
strings occur more than once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendlens.llm.arrow import pieces
from spendlens.llm.repeats import KEY_SEGMENTS, Laid, Method, answered, as_bytes, spans_of, unpacked, with_answers
from spendlens.llm.tables import NO_ID

WIDTH = 200
#: Bytes of the grams that windows are first filed under.
GRAM = 48
#: Units packed into one sort key: 9 bits each, as an end mark comes before all bytes.
PACKED = 7


def _packed(text: np.ndarray) -> np.ndarray:
    """At every place the next ``PACKED`` units as one number, in their order."""
    padded = np.concatenate([text, np.zeros(PACKED, np.uint64)])
    out = np.zeros(len(text), np.uint64)
    for i in range(PACKED):
        out = (out << np.uint64(9)) | padded[i : i + len(text)]
    return out


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is."""
    n = len(text)
    step = np.ones(n, np.int8)
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1]).astype(np.int8)
    place = np.where(step != 0, np.arange(n), n)
    # Among equal units the next step decides.
    decides = np.minimum.accumulate(place[::-1])[::-1]
    return step[decides] > 0


def _sorted(places: np.ndarray, keys: np.ndarray, prints: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of their first ``depth`` units; beyond, ties stay as they come.

    ``prints`` are hashes of the first ``depth`` units: ties with one print need no more rounds.
    """
    order = places[np.argsort(keys[places], kind="stable")]
    value = keys[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])[: len(order)]
    for at in range(PACKED, depth, PACKED):
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        marks = prints[order]
        mixed_up = np.minimum.reduceat(marks, heads) != np.maximum.reduceat(marks, heads)
        open_ = np.flatnonzero(mixed_up[group])
        if not len(open_):
            break
        own, own_group = order[open_], group[open_]
        key = keys[np.minimum(own + at, len(keys) - 1)]
        by = np.lexsort((key, own_group))
        order[open_] = own[by]
        key, own_group = key[by], own_group[by]
        differs = np.concatenate([[True], (key[1:] != key[:-1]) | (own_group[1:] != own_group[:-1])])
        new[open_] |= differs
    return order


def suffix_array(text: np.ndarray, keys: np.ndarray, prints: np.ndarray, depth: int) -> np.ndarray:
    """All places in the order of their suffixes' first ``depth`` units, by two-stage sorting."""
    small = _smaller(text)
    direct = _sorted(np.flatnonzero(small), keys, prints, depth)
    units = int(text.max(initial=0)) + 1
    first = np.searchsorted(text[direct], np.arange(units + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(units)]

    def induce(places: np.ndarray, unit: int) -> np.ndarray:
        """Hands the larger predecessors of sorted places to their buckets; returns those of this one."""
        before = places[places > 0] - 1
        before = before[~small[before]]
        bucket = text[before]
        own = before[bucket == unit]
        before, bucket = before[bucket != unit], bucket[bucket != unit]
        by = np.argsort(bucket, kind="stable")
        before, bucket = before[by], bucket[by]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting[int(text[part[0]])].append(part)
        return own

    done = []
    for unit in range(units):
        wave = np.concatenate(waiting[unit]) if waiting[unit] else direct[:0]
        waiting[unit] = []
        while len(wave):
            done.append(wave)
            wave = induce(wave, unit)
        part = direct[first[unit] : first[unit + 1]]
        done.append(part)
        induce(part, unit)
    return np.concatenate(done)


def repeated(segments: list[bytes], width: int) -> list[np.ndarray]:
    """Per segment, which of its ``width``-byte strings (``PACKED`` at least) occur anywhere else in them."""
    sizes = np.array([len(s) for s in segments], np.int64)
    joined = np.frombuffer(b"\0".join([*segments, b""]), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    text = joined.astype(np.uint64) + np.uint64(1)
    text[ends] = 0
    keys = _packed(text)
    left = np.repeat(ends, sizes + 1) - np.arange(len(text))
    laid = Laid(joined, np.arange(len(text)), np.arange(1, len(text) + 1), np.array([0, len(text)]))
    # A string cut short by its segment's end is known by what it has and its length.
    places = np.arange(len(text))
    held = np.minimum(left, width)
    prints = laid.hashes(places, places + np.maximum(held, 1) - 1) + held.astype(np.uint64)
    order = suffix_array(text.astype(np.int64), keys, prints, width)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero((left[a] >= width) & (left[b] >= width))
    for at in [*range(0, width - PACKED, PACKED), max(0, width - PACKED)]:
        same = same[keys[a[same] + at] == keys[b[same] + at]]
    twice = np.zeros(len(text), bool)
    twice[a[same]] = twice[b[same]] = True
    starts = ends - sizes
    return [twice[s : s + max(0, n - width + 1)] for s, n in zip(starts.tolist(), sizes.tolist())]


def solve(segments: list[bytes], times: np.ndarray, least: np.ndarray, width: int = WIDTH) -> list[bytes]:
    """Per segment, the runs of its windows that occur elsewhere, as 32-bit (start, end) pairs."""
    out = []
    for marks, n in zip(repeated(segments, width), times.tolist()):
        if n > 1:
            marks = np.ones(len(marks), bool)  # the segment itself occurs elsewhere
        edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
        out.append(edge.astype(np.int32).tobytes())
    return out


def removed_spans(first: np.ndarray, answers: list[bytes], width: int) -> np.ndarray:
    """The maximal removed runs of a text, as (start, end) rows."""
    if not answers:
        return np.zeros((0, 2), np.int64)
    sizes = np.fromiter(map(len, answers), np.int64, len(answers)) // 8
    pairs = np.frombuffer(b"".join(answers), np.int32).reshape(-1, 2) + np.repeat(first, sizes)[:, None].astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    pairs[:, 1] += width - 1  # the last window's end
    reach = np.maximum.accumulate(pairs[:, 1])
    heads = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return np.stack([pairs[heads, 0], reach[np.concatenate([heads[1:] - 1, [len(pairs) - 1]])]], axis=1)


def _method(width: int) -> Method:
    if width < PACKED:
        raise ValueError(f"width must be {PACKED} at least")
    return Method(as_bytes, width, min(GRAM, max(1, width // 2)), True, partial(solve, width=width))


def removals(docs: DataFrame, width: int = WIDTH, bound: int = KEY_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row of (doc_id, text).

    A byte goes if a string of ``width`` bytes that covers it also starts anywhere else,
    in its own text or another; strings are those of the input and may overlap. Rows that
    repeat a text, under one id or several, are each elsewhere to the other. A null or empty text has no bytes. ``kept``
    holds the remaining bytes, which need not be valid UTF-8.
    """
    found = with_answers(docs, answered(docs, _method(width), bound))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = [None if i == NO_ID else i for i in batch.column("doc_id").to_pylist()]
            rows = []
            for text, (first, answers) in zip(unpacked(batch.column("text")), spans_of(batch.column("spans"))):
                cuts = removed_spans(first, answers, width)
                edges = [0, *cuts.reshape(-1).tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept))
            sizes, removed, counts, prints, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(prints), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return found.mapInArrow(run, schema)
