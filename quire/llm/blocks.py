"""Arrow batches of texts as flat arrays of code points, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points worked on at once in a Python worker; a longer text makes a block of its own.
BLOCK = 1_000_000


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts together have about size bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and the bounds of each text in them (len(texts) + 1)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def strings(flat: np.ndarray, bounds: np.ndarray) -> list[str]:
    whole = flat.astype("<u4").tobytes().decode("utf-32-le")
    return [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
