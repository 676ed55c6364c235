"""Near-duplicates by the exact Jaccard similarity of word shingles.

Candidates come from SimHash fingerprints of these shingles, linked at a wide distance through the
Gray-order index; chains of such links make candidate components. Inside one of these every pair is
decided by its whole shingle sets, unless it is connected already. A candidate component
above a bound is dealt in blocks: each block is solved together with the component's least
member, and what that leaves apart is solved block against block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.arrow import flat, pieces
from spendlens.llm.components import components
from spendlens.llm.simhash import _hashes, wide_fingerprint, wide_links
from spendlens.llm.tables import NO_ID
from spendlens.session import free_shuffles

#: Words of a shingle, and the similarity from which two documents are linked, as a fraction.
WIDTH, SEED, LEAST = 5, 42, (4, 5)
#: The rate at which bits of fingerprints differ at the least similarity, and the most of the 256 compared bits: at that rate
#: more of them differ with a chance of 1e-6, and two unlike texts agree as well with one of 1e-14. (Of 128 bits they would
#: with one of 2e-5: chains of such chance pairs join ever more of the corpus to one candidate component as it grows.)
DIFFER, DISTANCE = math.acos(8 / 9) / math.pi, 68
#: Members and shingles of a block of a candidate component: each member is sent once per block, so blocks are large.
BLOCK_ROWS, BLOCK_UNITS = 2048, 1 << 19


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; a text shorter than a shingle is one."""
    data, bounds = flat(column)
    raw = data.tobytes()
    return [np.unique(np.array(_hashes(raw[a:b], width, SEED), np.uint64)) for a, b in zip(bounds[:-1], bounds[1:])]


def _marked(texts: DataFrame, width: int) -> DataFrame:
    """(id, print, code, fp) of rows of (id, print, text): equal shingle sets have equal codes; fp is null without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            sets = _sets(batch.column("text"), width)
            codes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("print"), pa.array(codes),
                 pa.array([wide_fingerprint(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["id", "print", "code", "fp"],
            )

    return texts.mapInArrow(run, "id long, print long, code long, fp binary")


def _with_sets(rows: DataFrame, width: int) -> DataFrame:
    """(root, code, units, shingles binary) of rows of (root, code, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            sets = _sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("root"), batch.column("code"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())],
                ["root", "code", "units", "shingles"],
            )

    return rows.select("root", "code", "text").mapInArrow(run, "root long, code long, units long, shingles binary")


def confirmed(sets: list[np.ndarray], labels: list[int], first: int) -> list[tuple[int, int]]:
    """Pairs of places, at least ``LEAST`` similar, that connect all such pairs of one of the ``first`` with any.

    Places of one label are connected from the start. No set is empty.
    """
    n = len(sets)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    head: dict[int, int] = {}
    for place, label in enumerate(labels):
        parent[place] = head.setdefault(label, place)
    apart, found = len(head) - 1, []
    if not apart:
        return found
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    kinds, units = np.unique(np.concatenate(sets), return_inverse=True)
    units = units.reshape(-1)
    mark = np.zeros(len(kinds), np.int32)
    up, down = LEAST
    for a in range(min(first, n - 1)):
        own = units[starts[a] : ends[a]]
        mark[own] = 1
        common = np.add.reduceat(mark.take(units[ends[a] :]), starts[a + 1 :] - ends[a])
        mark[own] = 0
        for b in (np.flatnonzero(down * common >= up * (sizes[a] + sizes[a + 1 :] - common)) + a + 1).tolist():
            mine, other = root(a), root(b)
            if mine != other:
                parent[other] = mine
                found.append((a, b))
                apart -= 1
                if not apart:
                    return found
    return found


def _solved(groups: DataFrame) -> DataFrame:
    """(a, b) confirmed links of rows of (root, i, j, code, label, inner, shingles), per (root, i, j).

    Pairs of two rows that are ``inner`` are passed over.
    """

    def solve(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("inner", "code", "label"))))
        at = {code: place for place, code in enumerate(table.column("code").to_pylist())}
        data = table.column("shingles")
        sets = [np.frombuffer(data[at[code]].as_py(), np.uint64) for _, code, _ in rows]
        links = confirmed(sets, [label for *_, label in rows], sum(not inner for inner, *_ in rows))
        ends = [pa.array([rows[pair[side]][1] for pair in links], pa.int64()) for side in (0, 1)]
        return pa.Table.from_arrays(ends, ["a", "b"])

    return groups.groupBy("root", "i", "j").applyInArrow(solve, "a long, b long")


def _blocks(rows: int) -> Column:
    """How many blocks the rows of a group are dealt in."""
    by_rows, by_units = F.ceil(F.count("*") / rows), F.ceil(F.sum("units") / BLOCK_UNITS)
    return F.greatest(by_rows, by_units).cast("long")


def _dealt(blocks: str) -> Column:
    return F.pmod(F.xxhash64("code"), F.col(blocks))


def _links(sets: DataFrame, rows: int) -> DataFrame:
    """(a, b): links that connect whatever members of one candidate component are similar."""
    sized = sets.join(sets.groupBy("root").agg(_blocks(rows).alias("blocks")), "root")
    mine = F.when(F.col("code") == F.col("root"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    near = sized.select(
        "root", F.explode(F.coalesce(mine, F.array(_dealt("blocks")))).alias("i"), F.lit(-1).cast("long").alias("j"),
        "code", F.col("code").alias("label"), F.lit(False).alias("inner"), "shingles",
    )
    links = _solved(near).checkpoint()
    large = sized.filter("blocks > 1")
    if large.isEmpty():
        return links
    # What is connected with the least member needs no look at each other any more.
    parts = components(links).withColumnsRenamed({"node": "code", "root": "label"})
    large = large.drop("blocks").join(parts, "code", "left").withColumn("label", F.coalesce("label", "code"))
    large = large.withColumn("inner", F.col("label") == F.col("root")).checkpoint()
    counts = large.groupBy("root", "inner").agg(_blocks(rows).alias("n"))
    counts = counts.groupBy("root").agg(
        F.max(F.when(~F.col("inner"), F.col("n"))).alias("outer_n"), F.max(F.when(F.col("inner"), F.col("n"))).alias("inner_n")
    )
    dealt = large.join(counts.filter("outer_n IS NOT NULL"), "root")
    own = F.when(F.col("inner"), F.col("outer_n") + _dealt("inner_n")).otherwise(_dealt("outer_n"))
    last = F.when(F.col("inner"), F.col("outer_n")).otherwise(F.col("outer_n") + F.col("inner_n")) - 1
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    far = dealt.select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "code", "label", "inner", "shingles",
    )
    return links.union(_solved(far))


def representatives(docs: DataFrame, width: int = WIDTH, rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each component of near-duplicates.

    Two documents are linked where their sets of ``width``-word shingles (A-Z in lower case)
    have a Jaccard similarity of 0.8 or more; each link is confirmed on the whole sets. A
    text shorter than a shingle is one shingle; texts without words equal one another only. A pair
    is confirmed where the fingerprints of the sets have made it a candidate; at 0.8 some table of the index
    joins it but for a chance of 1e-4 (texts of few words: see the README). It is the
    row of the least doc_id that stays (a null one is the largest), then of the least hash of the
    text; of rows equal in both any one.
    """
    row = F.struct("*").alias("row")
    text = F.coalesce("text", F.lit("")).alias("text")
    named = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text)
    named = named.withColumn("print", F.xxhash64("text"))
    marks = _marked(named.select("id", "print", "text"), width)
    nodes = marks.groupBy("code").agg(F.min(F.struct("id", "print")).alias("least"), F.first("fp").alias("fp"))
    nodes = nodes.checkpoint()
    candidates = components(wide_links(nodes.filter("fp IS NOT NULL"), DISTANCE, DIFFER))
    members = nodes.select("code", "least.id", "least.print").join(candidates.withColumnRenamed("node", "code"), "code")
    texts = named.select("id", "print", "text").join(members, ["id", "print"]).dropDuplicates(["code"])
    sets = _with_sets(texts, width).checkpoint()
    free_shuffles(docs.sparkSession)
    found = components(_links(sets, rows))
    rooted = nodes.select("code", "least").join(found.withColumnRenamed("node", "code"), "code", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "code"))
    stay = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.print")
    kept = named.drop("text").join(stay, ["id", "print"], "left_semi").dropDuplicates(["id", "print"])
    free_shuffles(docs.sparkSession)
    return kept.select("row.*")
