"""Arrow batches in parts, for Python code whose objects take several times the bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def few(batch: pa.RecordBatch, rows: int = 128, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and bytes; a row that is larger is a part of its own."""
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > most_bytes):
        half = batch.num_rows // 2
        yield from few(batch.slice(0, half), rows, most_bytes)
        yield from few(batch.slice(half), rows, most_bytes)
    elif batch.num_rows:
        yield batch
