"""SimHash near-duplicates: fingerprints linked through a Gray-order hierarchical index.

Fingerprints within ``distance`` bits agree on at least one of ``distance + 1`` bit
blocks, so each distinct fingerprint is sent to one bucket per block. A bucket that grows
beyond a bound is cut again by blocks of its remaining bits, which loses no link either. Inside a
bucket the fingerprints are sorted by Gray rank and grouped, eight by eight, into a tree:
a node holds the bits on which all below it agree and which its parent does not hold yet.
A search adds up differences from the root down, drops a group once they exceed the
distance, and takes a group whole when even its free bits cannot exceed it.

Blocks do not carry a wide distance: with every third bit free they part nothing. For such a
distance fingerprints are wide too, and filed in many tables, each under some of their bits
drawn at random; the index searches every bucket of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.arrow import flat, pieces
from spendlens.llm.components import components
from spendlens.llm.tables import NO_ID
from spendlens.session import free_shuffles

SHINGLE, SEED, DISTANCE, BITS = 4, 42, 4, 64
#: Rows of a bucket above which it is cut again.
BUCKET_ROWS = 4096
FAN = 8  # children of a node
PAIRS_AT_ONCE = 4_000_000
#: Words of a wide fingerprint; those of them that are compared.
WIDE, COMPARED = 8, 4
#: Tables that are filed at a time: the files of their shuffle go before the next ones are written.
TABLES_AT_ONCE = 32
#: Mean members of a bucket of a table, as a power of two; rows above which a bucket is held against its first one.
ROOM, CROWD = 6, 512
#: The chance that no table joins two codes whose bits differ at the rate that the tables are made for.
LOST = 1e-4
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _hashes(text: bytes, width: int, seed: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends = ends[width - 1 :].tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends)]


def fingerprint(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per group of hashes, the bits set in over half of them; 0 for an empty group."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, bounds[full], axis=0, dtype=np.int32)
        major = (2 * sums > n[full, None]).astype(np.uint8)
        out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Every row of (..., text) with its fingerprint, fp (long), for the text."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            data, bounds = flat(batch.column("text"))
            raw = data.tobytes()
            found = [_hashes(raw[a:b], width, seed) for a, b in zip(bounds[:-1], bounds[1:])]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            hashes = np.array([h for x in found for h in x], np.uint64)
            fp = fingerprint(hashes, ends).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(fp)], [*others, "fp"])

    return docs.mapInArrow(run, docs.select(*others).schema.add("fp", "long"))


_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` words, each a fingerprint of the hashes mixed in a way of its own; zeros for none."""
    sums = np.zeros(BITS * WIDE, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        words = hashes[start : start + (1 << 14), None] * _ODD
        words ^= words >> np.uint64(32)
        words *= _ODD[0]
        words ^= words >> np.uint64(29)
        sums += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * sums > len(hashes), bitorder="little").view(np.uint64)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _ones(codes: np.ndarray) -> np.ndarray:
    """The bits set in each code, a word or a row of words."""
    n = np.bitwise_count(codes)
    return n if codes.ndim == 1 else n.sum(axis=1, dtype=np.int64)


class GrayIndex:
    """The trees of several buckets at once; ``codes`` are words, or rows of words.

    Only leaves that ``ask`` (all by default) are searched for; where not all of a bucket ask, ``both``
    must be set for it, and its pairs come in both orders.
    """

    def __init__(
        self, buckets: np.ndarray, codes: np.ndarray, ask: np.ndarray | None = None, both: np.ndarray | None = None
    ):
        words = codes.reshape(len(codes), -1)
        order = np.lexsort((*(gray_rank(words[:, k]) for k in reversed(range(words.shape[1]))), buckets))
        self.bits = BITS * words.shape[1]
        # A wide distance passes over next to nothing: all pairs of a block of leaves are held at once.
        self.at_once = PAIRS_AT_ONCE if codes.ndim == 1 else PAIRS_AT_ONCE // 16
        self.ask = None if ask is None else ask[order]
        self.both = None if both is None else both[order]
        self.order, self.codes = order, codes[order]
        owner = buckets[order]
        first = np.arange(len(codes))
        mask, value = np.full(codes.shape, ALL), self.codes
        self.levels = [(mask, value, first, first + 1)]  # masks, values, first and end leaf
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        last = first + 1
        while len(owner) and np.any(owner[1:] == owner[:-1]):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(owner)]]))
            place = np.arange(len(owner)) - np.repeat(starts, sizes)
            heads = np.flatnonzero(place % FAN == 0)
            ends = np.concatenate([heads[1:], [len(owner)]])
            low = np.bitwise_and.reduceat(value, heads)
            high = np.bitwise_or.reduceat(value, heads)
            mask = np.bitwise_and.reduceat(mask, heads) & ~(low ^ high)
            value = low & mask
            first, last, owner = first[heads], last[ends - 1], owner[heads]
            self.levels.append((mask, value, first, last))
            self.children.append((heads, ends))
        self.roots = owner

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(leaf, first leaf, end leaf): the leaf is within distance of every leaf from first to end.

        Each pair within the distance comes in at least one of its two orders, unless a
        group that holds both is given once as (first, first, end): within it all link.
        """
        top = len(self.levels) - 1
        mask, _, first, last = self.levels[top]
        sizes = last - first
        # Blocks of leaves, so that a block against its buckets stays bounded.
        cost = np.cumsum(np.repeat(sizes, sizes))
        start = 0
        while start < len(self.codes):
            base = cost[start - 1] if start else 0
            stop = max(int(np.searchsorted(cost, base + self.at_once, "right")), start + 1)
            leaves = np.arange(start, stop)
            if self.ask is not None:
                leaves = leaves[self.ask[start:stop]]
            node = np.searchsorted(first, leaves, "right") - 1
            yield from self._search(leaves, node, top, distance)
            start = stop

    def _search(self, leaf, node, level, distance):
        away = np.zeros(len(leaf), np.int64)
        above = np.zeros((len(leaf), *self.codes.shape[1:]), np.uint64)  # bits judged further up
        while len(leaf):
            mask, value, first, last = self.levels[level]
            mine, end = mask[node], last[node]
            away = away + _ones((self.codes[leaf] ^ value[node]) & mine & ~above)
            free = self.bits - _ones(mine).astype(np.int64)
            later = end > leaf + 1
            if self.both is not None:
                later |= self.both[leaf]
            keep = (away <= distance) & later
            # The leaf alone needs no search; a group it can't miss is taken whole.
            whole = keep & (away + free <= distance)
            inside = whole & (first[node] <= leaf) & (leaf < end)
            lead = inside & (first[node] == leaf)
            if self.both is not None:
                lead |= inside & self.both[leaf]
            out = (whole & ~inside) | lead
            if out.any():
                yield leaf[out], first[node[out]], end[out]
            go = keep & ~whole
            if level == 0 or not go.any():
                return
            heads, ends = self.children[level - 1]
            leaf, node, away, above = leaf[go], node[go], away[go], mine[go]
            n = ends[node] - heads[node]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            node_down = np.repeat(heads[node], n) + step
            leaf, away, above = np.repeat(leaf, n), np.repeat(away, n), np.repeat(above, n, axis=0)
            node, level = node_down, level - 1


def _forest(index: GrayIndex, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs that connect whatever links connect: a leaf and its root, at most one a leaf."""
    parent = list(range(len(index.codes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for leaf, first, end in index.links(distance):
        single = end - first == 1
        for a, b in zip(leaf[single].tolist(), first[single].tolist()):
            parent[root(b)] = root(a)
        for a, lo, hi in zip(leaf[~single].tolist(), first[~single].tolist(), end[~single].tolist()):
            top = root(a)
            for b in range(lo, hi):
                parent[root(b)] = top
    roots = np.array([root(i) for i in range(len(parent))], np.int64)
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    return moved, roots[moved]


def _cuts(varying: int, mask: int, blocks: int) -> list[int]:
    """The masks of a bucket's parts: its mask with one block each of the bits that vary in it."""
    free = [b for b in range(BITS) if varying >> b & 1]
    ends = [len(free) * i // blocks for i in range(blocks + 1)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(ends, ends[1:])]


def _buckets(codes: DataFrame, distance: int, bound: int) -> DataFrame:
    """(fp, mask, value): buckets of at most ``bound`` rows in which every link is found.

    Two linked codes of a bucket differ in at most ``distance`` of the bits that vary in it,
    so they agree on one of ``distance + 1`` blocks of these. Bits on which all agree are
    left out of the blocks: each cut makes buckets smaller.
    """
    blocks = distance + 1

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, masks, bits = (
                batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "mask", "varying")
            )
            kinds, owner = np.unique(np.stack([masks, bits]), axis=1, return_inverse=True)
            parts = []
            for number, (held, varying) in enumerate(kinds.T.tolist()):
                own = fps[owner.reshape(-1) == number]
                for new in _cuts(varying, held, blocks):
                    parts.append((own, np.full(len(own), new, np.uint64), own & np.uint64(new)))
            if parts:
                columns = [np.concatenate(c).view(np.int64) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fp", "mask", "value"])

    schema = "fp long, mask long, value long"
    keys = ["mask", "value"]
    todo = codes.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(-1).cast("long").alias("varying"))
    done = None
    while True:
        rows = todo.mapInArrow(spread, schema).checkpoint()
        size = rows.groupBy(*keys).agg(
            F.count("*").alias("n"), F.expr("bit_or(fp) & ~bit_and(fp)").alias("varying")
        )
        # Where no more than ``distance`` bits vary a bucket has few codes anyway.
        large = size.filter((F.col("n") > bound) & (F.bit_count("varying") > distance)).drop("n").checkpoint()
        if large.isEmpty():
            return rows if done is None else done.union(rows)
        fine = rows.join(large, keys, "left_anti").select("fp", *keys)
        done = fine if done is None else done.union(fine)
        todo = rows.join(large, keys).select("fp", "mask", "varying")


def links(codes: DataFrame, distance: int = DISTANCE, bound: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) pairs of fingerprints that connect all that links of ``distance`` bits connect.

    ``codes`` holds each fingerprint once, as ``fp`` (long). Not every linked pair is
    returned: a spanning forest per bucket is, so a group of n close ones gives O(n) rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            keys = [table.column(c).to_numpy() for c in ("mask", "value")]
            new = np.concatenate([[True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])])
            index = GrayIndex(np.cumsum(new), table.column("fp").to_numpy().view(np.uint64))
            a, b = _forest(index, distance)
            codes = index.codes.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(codes[a]), pa.array(codes[b])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 2 * bound:
                continue
            table = pa.Table.from_batches(held)
            mask, value = (table.column(c).to_numpy() for c in ("mask", "value"))
            # The last bucket may go on in the next batch.
            cut = int(np.flatnonzero((mask != mask[-1]) | (value != value[-1]))[-1]) + 1
            yield solve(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
        if held:
            yield solve(pa.Table.from_batches(held))

    dealt = _buckets(codes, distance, bound).repartition("mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(run, "a long, b long")


def tables(n: int, differ: float, lost: float = LOST) -> np.ndarray:
    """The bits under which each table files ``n`` wide fingerprints, a row a table.

    Two codes whose bits differ at the rate ``differ``, each by itself, agree on the bits of no table with a
    chance of ``lost`` at most.
    """
    bits, held = BITS * WIDE, max(0, n.bit_length() - ROOM)
    places = [math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) for d in range(bits + 1)]
    chance = np.exp([p + d * math.log(differ) + (bits - d) * math.log1p(-differ) for d, p in enumerate(places)])
    agree = np.array([math.prod((bits - d - i) / (bits - i) for i in range(held)) if d + held <= bits else 0.0 for d in range(bits + 1)])
    number = 1
    while (chance * (1 - agree) ** number).sum() > lost:
        number += 1
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(bits, held, replace=False) for _ in range(number)])


def _joined(buckets: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that connect all codes of a bucket that differ in at most ``distance`` bits.

    In a crowded bucket those as near to the first member are joined with it, and ask no further.
    """
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(buckets)]]))
    head = np.repeat(starts, sizes)
    crowded = np.repeat(sizes > CROWD, sizes)
    near = crowded & (_ones(codes ^ codes[head]) <= distance)
    index = GrayIndex(buckets, codes, ~near, crowded)
    a, b = _forest(index, distance)
    joined = np.flatnonzero(near & (head != np.arange(len(head))))
    return np.concatenate([index.order[a], joined]), np.concatenate([index.order[b], head[joined]])


def wide_links(codes: DataFrame, distance: int, differ: float, at_once: int = 1 << 16) -> DataFrame:
    """(a, b) pairs of names that connect the codes that differ in at most ``distance`` of the compared bits.

    ``codes`` has (code, fp): a name (long) and the bytes of a wide fingerprint; it is read again and again. The tables
    are made for pairs whose bits differ at the rate ``differ`` (see ``tables``); nearer ones are found with
    a greater chance. A bucket's pairs are found by the index. ``TABLES_AT_ONCE`` tables are on disk at a time, whatever
    their number.
    """
    files, found = tables(codes.count(), differ), None
    for first in range(0, len(files), TABLES_AT_ONCE):
        links = _filed(codes, files[first : first + TABLES_AT_ONCE], distance, at_once).distinct().checkpoint()
        found = links if found is None else found.union(links)
        free_shuffles(codes.sparkSession)
    return found


def _filed(codes: DataFrame, files: np.ndarray, distance: int, at_once: int) -> DataFrame:
    """The links that some of the tables give; see ``wide_links``."""
    names = [f"w{k}" for k in range(COMPARED)]

    def file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, at_once // len(files))
        weight = np.int64(1) << np.arange(files.shape[1], dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                words = flat(part.column("fp"))[0].view(np.uint64).reshape(-1, WIDE)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                key = np.stack([bits[:, own] @ weight + (k << 40) for k, own in enumerate(files)]).astype(np.int64)
                code = part.column("code").to_numpy()
                own = [np.tile(x, len(files)) for x in (code, *words[:, :COMPARED].view(np.int64).T)]
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), *map(pa.array, own)], ["key", "code", *names])

    def solve(table: pa.Table) -> pa.RecordBatch:
        key, code, *words = (table.column(c).to_numpy() for c in ("key", "code", *names))
        a, b = _joined(key, np.stack(words, axis=1).view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(code[a]), pa.array(code[b])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < at_once:
                continue
            table = pa.Table.from_batches(held)
            # The last bucket may go on in the next batch.
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield solve(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    schema = ", ".join(f"{c} long" for c in ("key", "code", *names))
    dealt = codes.select("code", "fp").mapInArrow(file, schema).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def _rooted(classes: DataFrame, distance: int, bound: int) -> DataFrame:
    """(fp, least, root) of (fp, least) rows, one a fingerprint: root names its component."""
    found = components(links(classes.select("fp"), distance, bound))
    joined = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return joined.select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, bound: int = BUCKET_ROWS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of (doc_id, text).

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the least doc_id
    reachable over links of ``distance`` differing bits, the document itself included. Texts
    without words have fingerprint zero, linked like any other. Texts shorter than a
    shingle count as one. Rows that repeat an id keep one row each; a null id has the
    component's least id, or null if it has none. Equal fingerprints are reduced to one
    before any search, so thousands of copies are one node.
    """
    marks = fingerprints(docs.select("doc_id", "text"), width).checkpoint()
    rooted = _rooted(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), distance, bound)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # One row per fingerprint, then per document; both are plain joins that can be split.
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def representatives(
    docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, bound: int = BUCKET_ROWS
) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each component of near-duplicates.

    It is that of the least doc_id (a null one is the largest), then of the least hash of the text; of rows equal in
    both any one stays.
    """
    row = F.struct("*").alias("row")
    text = F.coalesce("text", F.lit("")).alias("text")
    named = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text)
    named = named.withColumn("print", F.xxhash64("text"))
    marks = fingerprints(named.select("id", "print", "text"), width).checkpoint()
    rooted = _rooted(marks.groupBy("fp").agg(F.min(F.struct("id", "print")).alias("least")), distance, bound)
    stay = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.print")
    kept = named.drop("text").join(stay, ["id", "print"], "left_semi").dropDuplicates(["id", "print"])
    return kept.select("row.*")
