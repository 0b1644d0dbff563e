"""Arrow batches cut to a bounded size, so that a worker's memory doesn't follow the length of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words worked on at once, and numbers of a matrix held at once (32 MB).
WORDS, CELLS = 1_000_000, 4_000_000


def pieces(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lists in a column have `most` entries in all (WORDS by default), or one row."""
    most, begin = most or WORDS, 0
    ends = batch.column(column).offsets.to_numpy()
    while begin < batch.num_rows:
        end = max(int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1, begin + 1)
        yield batch.slice(begin, min(end, batch.num_rows) - begin)
        begin = end


def rows_of(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list a row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))
