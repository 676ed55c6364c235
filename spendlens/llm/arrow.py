"""Arrow helpers shared by the operators: whole texts as flat byte arrays, in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that an operator turns into arrays at a time; a longer text comes alone.
PIECE_BYTES = 4 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a string or binary column as one uint8 array, and their n + 1 offsets."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column`` (or one row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, base + limit, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def texts(column: pa.Array) -> list[bytes]:
    """The values as bytes; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=field.type)
        for c, field in zip(columns, schema)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
