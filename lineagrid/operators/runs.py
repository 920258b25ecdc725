"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codes_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal values by equal numbers."""
    found = pc.dictionary_encode(column, null_encoding="encode")
    return (found.combine_chunks() if isinstance(found, pa.ChunkedArray) and found.num_chunks != 1 else found.chunk(0) if isinstance(found, pa.ChunkedArray) else found).indices.to_numpy()


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables of equal values of the sorted columns, put together across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy() for c in columns]
        new = np.zeros(batch.num_rows, bool)
        for c in codes:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(batch.column(c)[a].as_py() for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)
