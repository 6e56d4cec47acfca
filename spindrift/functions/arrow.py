"""Arrow batches in small parts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows and bytes at most, or of one row, so that not all
    texts of a batch are Python objects at once. A batch is given up before the next is
    read; the caller should give up its part likewise."""

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if b.num_rows <= rows and (b.num_rows <= 1 or b.nbytes <= size):
            yield b
            return
        half = b.num_rows // 2
        yield from cut(b.slice(0, half))
        yield from cut(b.slice(half))

    for b in batches:
        yield from cut(b)
        del b
