"""Exact top-k inner products: exhaustive term-at-a-time accumulation.

A component index is a term, a non-zero integer weight at it a posting. Every task holds
the postings of one batch of candidates, walks the terms of each query row, adds
``query weight * posting weight`` into a dense score array, and selects k by partitioning.
The lists of the tasks are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.session import shared_path

#: Queries that one pass over the candidates carries; more queries are more passes.
QUERY_BLOCK = 4096
#: Candidates scored at a time.
CANDIDATE_BLOCK = 8192

SCHEMA = "number long, copies int, query_id long, vec_id long, score long, own boolean"
RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, weights array<bigint>): floor(scale * x), x as double.

    Vectors that are null or hold a null, NaN or infinite component, and rows without an
    id, take no part. An empty vector stays and scores 0 with every other.
    """
    bad = F.exists(
        "embedding",
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return usable.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("weights"),
    )


def _matrix(weights: pa.Array) -> np.ndarray:
    """Rows as a dense int64 matrix; shorter rows are padded with zeros."""
    lengths = np.diff(weights.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = weights.flatten().to_numpy(zero_copy_only=False)
    return out


def _postings(matrix: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per term: the rows that hold it (None: all rows) and their weights."""
    out = []
    for column in matrix.T:
        rows = np.flatnonzero(column)
        whole = len(rows) == len(column)
        out.append((None if whole else rows, np.ascontiguousarray(column[rows])))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best by (score descending, id ascending), in that order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        room = k - len(above)
        if len(level) > room:
            level = level[np.argpartition(ids[level], room - 1)[:room]]
        chosen = np.concatenate([above, level])
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))]


def _same(row: np.ndarray, query: np.ndarray) -> bool:
    """Equal but for zeros at the end of the longer one."""
    width = min(len(row), len(query))
    return bool((row[:width] == query[:width]).all()) and not row[width:].any() and not query[width:].any()


def _scorer(query_ids: np.ndarray, copies: np.ndarray, queries: np.ndarray, k: int):
    """Per query of a block, the k best candidates of a task, and which of them equal the query itself."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = [[(t, int(row[t])) for t in np.flatnonzero(row)] for row in queries]
        kept_ids = [np.zeros(0, np.int64)] * len(query_ids)
        kept = [np.zeros(0, np.int64)] * len(query_ids)
        kept_own = [np.zeros(0, bool)] * len(query_ids)
        for batch in batches:
            for start in range(0, batch.num_rows, CANDIDATE_BLOCK):
                part = batch.slice(start, CANDIDATE_BLOCK)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                matrix = _matrix(part.column("weights"))
                postings = _postings(matrix)
                total = np.empty(len(ids), np.int64)
                for q, own in enumerate(query_ids):
                    total[:] = 0
                    for term, weight in terms[q]:
                        if term < len(postings):
                            rows, weights = postings[term]
                            if rows is None:
                                total += weight * weights
                            else:
                                total[rows] += weight * weights
                    best = _best(total, ids, k)
                    scores, names = total[best], ids[best]
                    same = names == own
                    for at in np.flatnonzero(same):
                        same[at] = _same(matrix[best[at]], queries[q])
                    scores = np.concatenate([kept[q], scores])
                    names = np.concatenate([kept_ids[q], names])
                    same = np.concatenate([kept_own[q], same])
                    best = _best(scores, names, k)
                    kept[q], kept_ids[q], kept_own[q] = scores[best], names[best], same[best]
        counts = [len(x) for x in kept]
        if sum(counts):
            yield pa.RecordBatch.from_pydict(
                {
                    "number": np.repeat(np.arange(len(query_ids), dtype=np.int64), counts),
                    "copies": np.repeat(copies, counts),
                    "query_id": np.repeat(query_ids, counts),
                    "vec_id": np.concatenate(kept_ids),
                    "score": np.concatenate(kept),
                    "own": np.concatenate(kept_own),
                }
            )

    return score


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of the tasks' k + 1 best each, without the query's own row."""
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    place = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    first_own = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("number"))
    # Rows behind the query's own move up by one.
    behind = F.coalesce((F.col("own_place") < F.col("place")).cast("int"), F.lit(0))
    others = place.withColumn("own_place", first_own).filter(~F.col("place").eqNullSafe(F.col("own_place")))
    ranked = others.withColumn("rank", F.col("place") - behind).filter(F.col("rank") <= k)
    each = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return ranked.select("query_id", "rank", "vec_id", "score", each).drop("copy")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products per query.

    Both inputs are ``quantised`` frames. Every row of ``queries`` is a query of its own, with its
    own ranks, also where rows share an id; equal rows are scored once and their result repeated.
    One candidate row with the query's id and vector is the query itself and never counts; all
    other rows do. Ties go to the smaller vec_id. No query or no candidate gives no row. Queries
    go out in blocks of about ``block`` different rows, one pass over the candidates each; the
    result of a block is written to the shared folder before the next is collected, so the driver
    holds one block at a time.
    """
    spark = candidates.sparkSession
    asked = queries.groupBy("vec_id", "weights").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    blocks = max(1, -(-asked.count() // block))
    dealt = F.pmod(F.xxhash64("vec_id", "weights"), F.lit(blocks))
    folder = shared_path(spark, "topk")
    paths = []
    for number in range(blocks):
        rows = asked.filter(dealt == number).orderBy("vec_id", "weights").collect()
        if not rows:
            continue
        matrix = np.zeros((len(rows), max(len(r["weights"]) for r in rows)), np.int64)
        for at, row in enumerate(rows):
            matrix[at, : len(row["weights"])] = row["weights"]
        ids, copies = (np.array([r[name] for r in rows], kind) for name, kind in (("vec_id", np.int64), ("copies", np.int32)))
        found = candidates.mapInArrow(_scorer(ids, copies, matrix, k + 1), SCHEMA)
        paths.append(f"{folder}/{number}")
        _merged(found, k).write.parquet(paths[-1])
    if not paths:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*paths)
