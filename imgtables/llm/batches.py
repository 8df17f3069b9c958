"""Arrow batches cut by bytes, so that a worker's memory does not depend on text lengths."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20


def value_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each string or binary value; a null counts zero."""
    if len(column) == 0:
        return np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return np.diff(offsets[column.offset:column.offset + len(column) + 1].astype(np.int64))


def sliced(batches: Iterable[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the values of ``name`` in one piece stay near ``limit`` bytes.

    A value longer than the limit is a piece of its own; no value is cut.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        piece = (np.cumsum(value_sizes(batch.column(batch.schema.names.index(name)))) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(start, stop - start)


def gathered(batches: Iterable[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.Table]:
    """Join short pieces until the values of ``name`` reach about ``limit`` bytes."""
    held, size = [], 0
    for batch in sliced(batches, name, limit):
        held.append(batch)
        size += int(value_sizes(batch.column(batch.schema.names.index(name))).sum())
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
