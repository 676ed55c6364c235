"""One registered query per operator, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import alignment, decontaminate, html, minhash, mixing, pieces_fst, quality, simhash, substring, suffixes, topk, toxicity, variants
from spendlens.llm.tables import fold, id_and_text, table
from spendlens.session import shared_root

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_root(spark)  # checkpoints need their folder
    return id_and_text(table(spark, sf_dir, "documents"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score_toxicity(_documents(spark, sf_dir), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(_documents(spark, sf_dir), fold("doc_id", 7) == 2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 3) == 1
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score_quality(_documents(spark, sf_dir), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_fst.encode(_documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removals(_documents(spark, sf_dir))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removals(_documents(spark, sf_dir)).drop("kept")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_documents(spark, sf_dir))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_html": op1_html,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_topk": op6_topk,
    "op7_simhash": op7_simhash,
    "op8_substring": op8_substring,
    "op9_suffixes": op9_suffixes,
    "op10_pieces": op10_pieces,
    "op11_variants": op11_variants,
    "op12_minhash": op12_minhash,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {
    "op6_topk": """
        WITH usable AS MATERIALIZED (
            SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.own <> c.own
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank,
                   vec_id, score
            FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
}
