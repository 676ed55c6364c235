"""The corpus pipeline: documents through filters, duplicate removal and tokenization.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the
rows that it keeps, with the columns of ``documents``; the last returns tokens. Each
stage's rows are written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import decontaminate, pieces_fst, shingles, substring, toxicity
from spendlens.llm.tables import fold, id_and_text, table
from spendlens.session import shared_path, shared_root, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the network, learnt outside fold 0 of 5, calls toxic."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    network = toxicity.learn(id_and_text(docs), labels.select("doc_id", F.col("toxic").alias("label")))
    return toxicity.without_toxic(docs, network)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents whose 5-word shingles are 0.8 similar or more."""
    small_batches(spark)
    shared_root(spark)
    return shingles.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without words of 13-word windows that an earlier one has."""
    small_batches(spark)
    shared_root(spark)
    return substring.rewritten(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, within its edit budget."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every document."""
    small_batches(spark)
    return pieces_fst.encode(id_and_text(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring", drop_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("pieces", tokenize),
]

#: Trained scores, shingles by XXH64 and tokens have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
