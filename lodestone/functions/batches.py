"""Arrow batches in steps of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def steps(batches: Iterator[pa.RecordBatch], column: str | int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with some `limit` bytes in a text or binary column (a single longer value makes a longer step)."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
