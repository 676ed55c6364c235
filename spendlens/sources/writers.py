"""Sinks: tables, result documents and fitted models, all written as folders."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from spendlens.operators.regression import LinearModel, model_from_table, model_table
from spendlens.operators.tables import small_table

# Fixed value: the name outputs start with when none is configured.
DEFAULT_PREFIX = "mmm_results"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header; quotes inside text are doubled."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_parquet(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None
) -> str:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_series_table(
    df: DataFrame,
    name: str,
    path: str,
    buckets: int,
    keys: Sequence[str] = ("geo",),
    order: Sequence[str] = ("week",),
    mode: str = "overwrite",
) -> str:
    """A catalog table in buckets of ``keys``, whose files are sorted by keys and order.

    Windows and joins on the keys read it without a shuffle. The rows reach the writing tasks by
    ranges of keys and order, so that a crowded key is written by many tasks (into files of one
    bucket) and the others leave few files each.
    """
    dealt = df.repartitionByRange(*keys, *order)
    writer = dealt.write.mode(mode).format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(name)
    return name


def write_results_json(results: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Result rows (section, name, value) as JSON lines."""
    results.write.mode(mode).json(path)
    return path


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("section string, name string, value string").json(path)


def save_model(spark: SparkSession, model: LinearModel, path: str, mode: str = "overwrite") -> str:
    model_table(spark, model).coalesce(1).write.mode(mode).parquet(path)
    return path


def load_model(spark: SparkSession, path: str) -> LinearModel:
    return model_from_table(spark.read.parquet(path))


class Staging:
    """Outputs that appear together.

    Each is written to a hidden folder beside its place. ``publish`` moves them when all are
    there, manifests last: where a manifest is, everything it names is whole.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.label = f"_staged-{uuid.uuid4().hex}"
        self.moves: list[tuple[str, str]] = []
        self.manifests: list[tuple[str, str]] = []
        self.table: DataFrame | None = None

    def path(self, final: str, manifest: bool = False) -> str:
        """Where to write what is to appear at ``final``."""
        folder, name = final.rsplit("/", 1)
        staged = f"{folder}/{self.label}/{name}"
        (self.manifests if manifest else self.moves).append((staged, final))
        return staged

    def written_once(self, df: DataFrame, final: str) -> DataFrame:
        """Write ``df`` as parquet; further places and forms are made from the first one's files."""
        staged = write_parquet(df if self.table is None else self.table, self.path(final))
        if self.table is None:
            self.table = self.spark.read.parquet(staged)
        return self.table

    def _at(self, path: str) -> tuple[Any, Any]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def publish(self) -> None:
        for _, final in self.manifests:
            system, where = self._at(final)
            system.delete(where, True)
        for staged, final in [*self.moves, *self.manifests]:
            system, where = self._at(final)
            system.delete(where, True)
            if not system.rename(self._at(staged)[1], where):
                raise OSError(f"could not move {staged} to {final}")

    def discard(self) -> None:
        """Remove the hidden folders."""
        for folder in {staged.rsplit("/", 1)[0] for staged, _ in [*self.moves, *self.manifests]}:
            system, where = self._at(folder)
            system.delete(where, True)


@contextmanager
def published_together(spark: SparkSession) -> Iterator[Staging]:
    """Outputs staged inside appear at the end, or none of them after a failure."""
    staging = Staging(spark)
    try:
        yield staging
        staging.publish()
    finally:
        staging.discard()


def export_results(
    spark: SparkSession,
    df: DataFrame,
    model: LinearModel,
    results: DataFrame,
    base_path: str,
    prefix: str = DEFAULT_PREFIX,
    enabled: bool = True,
    staging: Staging | None = None,
) -> dict[str, str]:
    """Write results, feature table and model below ``base_path``; return the paths.

    The base may be any file system Spark reaches: local, distributed or object store.
    The feature table is computed once, as parquet, and turned to CSV from there. All outputs
    appear together, with a manifest (output, path) as the last one.
    """
    if not enabled:
        return {}
    if staging is None:
        with published_together(spark) as staging:
            return export_results(spark, df, model, results, base_path, prefix, enabled, staging)
    base = f"{base_path.rstrip('/')}/{prefix}"
    files = {
        "results_json": f"{base}_results.json",
        "processed_data_parquet": f"{base}_processed_data.parquet",
        "processed_data_csv": f"{base}_processed_data.csv",
        "model_table": f"{base}_model.parquet",
    }
    write_results_json(results, staging.path(files["results_json"]))
    table = staging.written_once(df, files["processed_data_parquet"])
    write_csv(table, staging.path(files["processed_data_csv"]))
    save_model(spark, model, staging.path(files["model_table"]))
    manifest = small_table(spark, list(files.items()), "output string, path string")
    files["manifest"] = f"{base}_manifest.json"
    manifest.coalesce(1).write.json(staging.path(files["manifest"], manifest=True))
    return files


def export_by_config(
    spark: SparkSession,
    df: DataFrame,
    model: LinearModel,
    results: DataFrame,
    config: Mapping[str, Any],
) -> dict[str, dict[str, str]]:
    """Write to each place that is switched on: ``local`` by default, others if asked.

    ``remote`` has a path, ``gcs`` a bucket and a path in it. Without an ``output_prefix``
    the names start with the time, so that no run replaces another's results. The feature
    table is computed once for all places, and what fails in one leaves no output in any.
    """
    if not config.get("save_results", True):
        return {}
    stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    prefix = config.get("output_prefix") or f"{DEFAULT_PREFIX}_{stamp}"
    places: dict[str, str] = {}
    local = config.get("local", {})
    if local.get("enabled", True):
        folder = local.get("dir") or config.get("dir") or config.get("output_dir")
        if not folder:
            raise ValueError("set output.local.dir, or switch output.local off")
        places["local"] = folder
    remote = config.get("remote", {})
    if remote.get("enabled", False):
        if not remote.get("path"):
            raise ValueError("output.remote is on but has no path")
        places["remote"] = remote["path"]
    bucket = config.get("gcs", {})
    if bucket.get("enabled", False):
        if not bucket.get("bucket"):
            raise ValueError("output.gcs is on but has no bucket")
        places["gcs"] = f"gs://{bucket['bucket']}/{bucket.get('path', '').strip('/')}".rstrip("/")
    with published_together(spark) as staging:
        return {
            place: export_results(spark, df, model, results, folder, prefix, True, staging)
            for place, folder in places.items()
        }
