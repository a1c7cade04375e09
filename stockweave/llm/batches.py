"""Arrow batches cut so that a task works on a bounded amount at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` (text, bytes or list) adds up to about ``most`` units; a row is never cut."""
    data = batch.column(column)
    sizes = pc.list_value_length(data) if pa.types.is_list(data.type) else pc.binary_length(data)
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False)) if len(batch) else np.zeros(0)
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
