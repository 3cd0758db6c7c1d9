"""Arrow batches cut into blocks of bounded size, so that a task's memory does not follow its partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 2048


def text_blocks(
    batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = BLOCK_BYTES, max_rows: int = BLOCK_ROWS
) -> Iterator[pa.RecordBatch]:
    """Slices of each batch with about ``max_bytes`` of ``column`` in each; one longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, length in enumerate(lengths.tolist()):
            if i > start and (size + length > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += length
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a block; null is an empty text."""
    return [text or "" for text in batch.column(column).to_pylist()]


def joined_bytes(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and the n + 1 offsets of the texts in them."""
    values = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
