"""Arrow batches in slices of bounded text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice holds, unless a single row holds more.
SLICE_BYTES = 1 << 19


def sliced(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of batches with up to `limit` bytes in `column` each, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        at = 0
        while at < n:
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right"))
            end = max(end, at + 1)
            yield batch.slice(at, end - at)
            at = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice, null as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... counts[i] of them, for every i in turn."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    step = np.ones(ends[-1], np.int64)
    some = counts > 0
    s, c, e = starts[some], counts[some], ends[some]
    step[0] = s[0]
    step[e[:-1]] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(step)
