"""Arrow batches in parts of bounded size, so that a task's memory follows the part and not the batch that Spark hands it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

BYTES = 1 << 20
"""Bytes of text of a part; a longer text is a part of its own."""


def parts(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about BYTES (or `most`) bytes of a text column."""
    most = most or BYTES
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for i, size in enumerate(sizes):
        if i > at and held + size > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)
