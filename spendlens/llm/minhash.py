"""Near-duplicates by min-hash: universal hash minima, bands, signatures, exact confirmation, stars.

Each distinct shingle set gets ``BANDS * ROWS`` minima of universal hashes. Sets that agree on
all rows of a band meet in a bucket. Two steps then find links, both ending in the whole sets:

1. *Stars.* Every member of a bucket is held against the bucket's least member only, so a
   bucket of n sets gives n - 1 pairs. Pairs whose signatures agree too little are dropped,
   the others are confirmed on the whole sets, a crowded head in blocks of its members.
2. *The rest.* Buckets whose members carry more than one label after that are gathered into
   regions. Their signatures are compared block against block; only sets with a like
   signature under another label go on, and are confirmed in blocks that emit a spanning
   forest. What is connected already is not looked at again, so copies cost one star each.

Components come from alternating large-star and small-star. Neither documents, links
nor components are ever collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.arrow import flat, pieces
from spendlens.llm.components import components
from spendlens.llm.shingles import confirmed
from spendlens.llm.simhash import _hashes
from spendlens.session import shared_path

#: Words of a shingle. The least similarity, 80 of 100, is that of ``shingles.confirmed``.
WIDTH, SEED = 4, 42
#: A pair at similarity 0.8 meets in no bucket with a chance of (1 - 0.8^5)^40 = 1.3e-7.
BANDS, ROWS = 40, 5
#: Equal minima that a pair must have to be confirmed: at similarity 0.8 they are 160 of 200
#: on average with a deviation of 5.7, so seven deviations less are let through.
LEAST_EQUAL = 120
#: Members of a block of whole sets (and their shingles), and of a block of signatures.
BLOCK_ROWS, BLOCK_UNITS, SIGNATURE_ROWS = 512, 1 << 20, 2048

_random = np.random.default_rng(7)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; with fewer words the whole sequence is one."""
    data, bounds = flat(column)
    raw = data.tobytes()
    return [np.unique(np.array(_hashes(raw[a:b], width, SEED), np.uint64)) for a, b in zip(bounds[:-1], bounds[1:])]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row a set: the minimum of each universal hash over its shingles. No set is empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.empty((len(sets), len(_FACTORS)), np.uint64)
    if len(sets):
        hashes = np.concatenate(sets)
        starts = np.cumsum(sizes) - sizes
        work = np.empty_like(hashes)
        for n, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS)):
            np.multiply(hashes, factor, out=work)
            work += shift
            out[:, n] = np.minimum.reduceat(work, starts)
    return out


def signatures(least: np.ndarray) -> np.ndarray:
    """16 well-mixed bits of each minimum."""
    return ((least * _MIX) >> np.uint64(48)).astype(np.uint16)


def band_keys(least: np.ndarray) -> np.ndarray:
    """The key of each band: a hash of its minima and its number."""
    keys = np.zeros((len(least), BANDS), np.uint64)
    for row in range(ROWS):
        keys ^= least[:, row::ROWS]
        keys *= _MIX
        keys ^= keys >> np.uint64(29)
    return (keys ^ np.arange(BANDS, dtype=np.uint64)) * _MIX


def _listed(full: np.ndarray, rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per place of ``full``; the rows are those of the places that hold."""
    width = rows.shape[1]
    bounds = np.concatenate([[0], np.cumsum(np.where(full, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(rows.reshape(-1), kind))


def _marked(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, print, n_shingles, code, keys, signature) of rows of (doc_id, print, text).

    Equal sets have equal codes; a text without words has none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            sets = _sets(batch.column("text"), width)
            full = np.array([len(s) > 0 for s in sets], bool)
            codes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            least = minima([s for s in sets if len(s)])
            signed = iter(signatures(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("print"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(codes, mask=~full), _listed(full, band_keys(least).view(np.int64), pa.int64()),
                 pa.array([next(signed).tobytes() if f else None for f in full], pa.binary())],
                ["doc_id", "print", "n_shingles", "code", "keys", "signature"],
            )

    schema = "doc_id long, print long, n_shingles long, code long, keys array<long>, signature binary"
    return texts.select("doc_id", "print", "text").mapInArrow(run, schema)


def _with_sets(rows: DataFrame, width: int) -> DataFrame:
    """(code, units, shingles binary) of rows of (code, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            sets = _sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("code"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())],
                ["code", "units", "shingles"],
            )

    return rows.select("code", "text").mapInArrow(run, "code long, units long, shingles binary")


def _rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Signatures as the rows of an array."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (code, head) pairs whose signatures agree often enough."""
    signed = nodes.select("code", "signature")
    both = pairs.join(signed, "code").join(
        signed.withColumnsRenamed({"code": "head", "signature": "other"}), "head"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_rows_of(batch.column("signature")) == _rows_of(batch.column("other"))).sum(axis=1)
                yield batch.select(["code", "head"]).filter(pa.array(equal >= LEAST_EQUAL))

    return both.select("code", "head", "signature", "other").mapInArrow(run, "code long, head long")


def _blocks(rows: int) -> Column:
    """How many blocks the rows of a group are dealt in."""
    by_units = F.ceil(F.sum("units") / BLOCK_UNITS)
    return F.greatest(F.ceil(F.count("*") / rows), by_units).cast("long").alias("blocks")


def _dealt(blocks: str = "blocks") -> Column:
    return F.pmod(F.xxhash64("code"), F.col(blocks))


def _stars(pairs: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """(a, b): the (code, head) pairs that are similar, by their whole sets."""
    members = pairs.join(sets, "code")
    sized = members.groupBy("head").agg(_blocks(rows))
    spokes = members.join(sized, "head").select("head", _dealt().alias("block"), "code", "shingles")
    hubs = sized.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    hubs = hubs.withColumn("code", F.col("head")).join(sets.select("code", "shingles"), "code")

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        codes = table.column("code").to_pylist()
        order = sorted(range(len(codes)), key=lambda i: (codes[i] != key[0].as_py(), codes[i]))
        data = table.column("shingles")
        links = confirmed([np.frombuffer(data[i].as_py(), np.uint64) for i in order], list(range(len(order))), 1)
        ends = [pa.array([codes[order[pair[side]]] for pair in links], pa.int64()) for side in (0, 1)]
        return pa.Table.from_arrays(ends, ["a", "b"])

    dealt = spokes.unionByName(hubs.select("head", "block", "code", "shingles"))
    return dealt.groupBy("head", "block").applyInArrow(solve, "a long, b long")


def _suspects(rest: DataFrame, rows: int) -> DataFrame:
    """The codes of (region, code, label, signature) with a like signature under another label of the region."""
    sized = rest.join(rest.groupBy("region").agg(F.ceil(F.count("*") / rows).cast("long").alias("blocks")), "region")
    sized = sized.withColumn("own", _dealt())
    sized = sized.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = sized.select(
        "region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "code", "label", "signature",
    )

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        codes, labels = (table.column(c).to_numpy() for c in ("code", "label"))
        signed, own = _rows_of(table.column("signature")), table.column("own").to_numpy()
        near = np.zeros(len(codes), bool)
        here, there = (np.flatnonzero(own == key[side].as_py()) for side in (1, 2))
        for a in here:
            b = there[labels[there] != labels[a]]
            like = b[(signed[b] == signed[a]).sum(axis=1) >= LEAST_EQUAL]
            near[like] = True
            near[a] |= len(like) > 0
        return pa.table({"region": table.column("region").filter(pa.array(near)), "code": codes[near]})

    # Dealt by block: partitions by region alone would do for the groups, and hold a crowded region in one task.
    dealt = dealt.repartition("region", "i", "j")
    found = dealt.groupBy("region", "i", "j").applyInArrow(solve, "region long, code long")
    return found.distinct()


def _within(rest: DataFrame, rows: int) -> DataFrame:
    """(a, b): links that connect whatever rows of (region, code, label, units, shingles) are similar."""
    sized = rest.join(rest.groupBy("region").agg(_blocks(rows)), "region").withColumn("own", _dealt())
    sized = sized.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = sized.select(
        "region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "code", "label", "shingles",
    )

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        codes, labels, own = (table.column(c).to_pylist() for c in ("code", "label", "own"))
        order = sorted(range(len(codes)), key=lambda i: (own[i], codes[i]))
        data = table.column("shingles")
        first = sum(o == key[1].as_py() for o in own)
        links = confirmed(
            [np.frombuffer(data[i].as_py(), np.uint64) for i in order], [labels[i] for i in order], first
        )
        ends = [pa.array([codes[order[pair[side]]] for pair in links], pa.int64()) for side in (0, 1)]
        return pa.Table.from_arrays(ends, ["a", "b"])

    dealt = dealt.repartition("region", "i", "j")
    return dealt.groupBy("region", "i", "j").applyInArrow(solve, "a long, b long")


def _links(filed: DataFrame, nodes: DataFrame, sets: DataFrame, pairs: DataFrame, rows: int, signed: int) -> DataFrame:
    """(a, b): links that connect all sets that are similar and share a bucket."""
    stars = _stars(_alike(pairs, nodes), sets, rows).checkpoint()
    labels = components(stars).withColumnsRenamed({"node": "code", "root": "label"})
    filed = filed.join(labels, "code", "left").withColumn("label", F.coalesce("label", "code"))
    mixed = filed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    rest = filed.join(mixed.filter("least < most").select("key", "least"), "key").select("code", "label", "least")
    rest = rest.distinct().checkpoint()
    # Labels in place of their members: a region is a chain of labels that share buckets.
    chains = components(rest.select("label", "least")).withColumnsRenamed({"node": "label", "root": "region"})
    rest = rest.select("code", "label").distinct().join(chains, "label").checkpoint()
    like = _suspects(rest.join(nodes.select("code", "signature"), "code"), signed)
    return stars.union(_within(rest.join(like, ["region", "code"]).join(sets, "code"), rows))


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, rows: int = BLOCK_ROWS, signature_rows: int = SIGNATURE_ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text, any others).

    A row's set holds the distinct ``width``-word shingles of its whole text, A-Z in lower
    case, words between ASCII white space; with fewer words the whole sequence is the one
    shingle. Null and empty texts, and those without words, have an empty set: n_shingles 0,
    linked with nothing. Rows are linked where 100 * intersection >= 80 * union; repeated rows
    and equal sets always are. ``component_id`` is the least doc_id that links reach, a null id counting as
    the largest; a row is kept if that is its own id. Rows that share an id are each judged, and
    so may be kept both. A very long text is one task's array of shingles; other columns are not looked at.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = named.withColumn("print", F.xxhash64("text"))
    path = shared_path(spark, "minhash-marks")
    _marked(named, width).write.parquet(path)
    marks = spark.read.parquet(path)
    path = shared_path(spark, "minhash-nodes")
    marks.filter("code IS NOT NULL").groupBy("code").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")).alias("least"),
        F.first("keys").alias("keys"), F.first("signature").alias("signature"),
    ).write.parquet(path)
    nodes = spark.read.parquet(path)

    filed = nodes.select("code", F.explode("keys").alias("key"))
    heads = filed.groupBy("key").agg(F.min("code").alias("head"), F.max("code").alias("tail")).filter("head < tail")
    filed = filed.join(heads.select("key", "head"), "key").checkpoint()
    pairs = filed.filter("code > head").select("code", "head").distinct().checkpoint()
    members = pairs.select("code").union(pairs.select("head")).distinct().join(
        nodes.select("code", "least.doc_id", "least.print"), "code"
    )
    same = named["print"].eqNullSafe(members["print"]) & named["doc_id"].eqNullSafe(members["doc_id"])
    texts = named.join(members, same).select("code", "text").dropDuplicates(["code"])
    path = shared_path(spark, "minhash-sets")
    _with_sets(texts, width).write.parquet(path)
    sets = spark.read.parquet(path)

    found = components(_links(filed.select("code", "key"), nodes, sets, pairs, rows, signature_rows))
    rooted = nodes.select("code", "least").join(found.withColumnRenamed("node", "code"), "code", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "code"))
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    rooted = rooted.select("code", "root").join(least, "root").select("code", F.col("first.doc_id").alias("component_id"))
    whole = marks.filter("code IS NOT NULL").select("doc_id", "n_shingles", "code").join(rooted, "code")
    empty = marks.filter("code IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = whole.select("doc_id", "n_shingles", "component_id").unionByName(empty)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
