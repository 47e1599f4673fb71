"""Arrow batches in parts of which a worker holds one at a time as Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def slices(batch: pa.RecordBatch, rows: int = 256, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order: at most ``rows`` at a time, and fewer where they are large."""
    lo = 0
    while lo < batch.num_rows:
        n = min(rows, batch.num_rows - lo)
        while n > 1 and batch.slice(lo, n).nbytes > most_bytes:
            n = -(-n // 2)
        yield batch.slice(lo, n)
        lo += n
    pa.default_memory_pool().release_unused()
