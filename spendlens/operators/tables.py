"""Result tables of a few rows that were computed already."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}


def small_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A local table; unlike one made of Python rows, reading it needs no Python worker.

    ``schema`` is text such as ``"feature string, value double"``.
    """
    fields = [part.split() for part in schema.split(",")]
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(list(c), type=_ARROW[kind]) for c, (_, kind) in zip(columns, fields)]
    table = pa.Table.from_arrays(arrays, names=[name for name, _ in fields])
    return spark.createDataFrame(table, schema)
