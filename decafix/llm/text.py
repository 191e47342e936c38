"""Batches of texts for Python stages: whole texts, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a stage works on at once; a longer text is alone in its piece.
PIECE_BYTES = 1 << 22


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut where its texts reach ``most`` bytes, so that numpy's temporaries stay bounded."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    at = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, (at[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and the n + 1 bounds of the texts in it."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds
