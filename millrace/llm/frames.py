"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 1 << 20


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Results replace input columns of the same name, in any case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of the text column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = at + 1
            while end < batch.num_rows and offsets[end + 1] - offsets[at] <= limit:
                end += 1
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array):
    """(bytes of all texts, where each begins): null counts as empty."""
    import numpy as np

    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def map_slices(df: DataFrame, text: str, work: Callable, keep: list[str], added: list[T.StructField],
               limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``work(slice) -> list of Arrow arrays`` in tasks; ``keep`` columns go through unchanged."""
    read = list(dict.fromkeys([*keep, text]))
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*(fields[c] for c in keep), *added])
    names = [*keep, *(f.name for f in added)]

    def run(batches):
        for batch in slices(batches, text, limit):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *work(batch)], names=names)

    return df.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, schema)
