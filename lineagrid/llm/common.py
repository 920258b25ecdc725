"""What the operators share: the shared scratch folder, bounded pieces of Arrow batches, and column checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import fresh_path, shared_folder, staged  # noqa: F401


#: Bytes of text that numpy works on at a time where a byte takes some forty in working arrays.
SMALL = 1 << 19


def need(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing column: {', '.join(missing)}")


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(*names: str) -> list[Column]:
    """Columns by their exact names, which may hold dots or back-ticks."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1, ... and their names: Arrow maps cannot take names that hold dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def numbered_schema(schema: T.StructType, *names: str) -> T.StructType:
    """The schema with columns c0, c1, ..., the last ones called `names`."""
    fields, n = schema.fields, len(schema.fields) - len(names)
    return T.StructType([T.StructField(f"c{i}" if i < n else names[i - n], f.dataType) for i, f in enumerate(fields)])


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that `column` holds at most about most_bytes in each; one longer row stands alone.

    Memory that Arrow holds for later is given back at the end: a worker lives on through other stages.
    """
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most_bytes:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]
