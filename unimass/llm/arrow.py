"""Whole texts inside Arrow tasks: slices of bounded size and views of their bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


def texts_of(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns and the text, a null text as an empty one; other columns are left out."""
    return docs.select(*[F.col(k) for k in keys],
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS,
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows and about `size` bytes of text.

    A single longer text is a batch of its own.
    """
    for batch in batches:
        lengths = np.diff(offsets(batch.column("text")))
        start = 0
        while start < batch.num_rows:
            held = np.cumsum(lengths[start:start + rows])
            n = max(1, int(np.searchsorted(held, size, side="right")))
            yield batch.slice(start, n)
            start += n


def offsets(column: pa.Array) -> np.ndarray:
    """Where each text begins in the bytes of its column, and where the last one ends."""
    wide = column.cast(pa.large_binary())
    return np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column one after the other, and the bounds of its texts in them."""
    wide = column.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    if not len(wide) or at[0] == at[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    data = np.frombuffer(wide.buffers()[2], np.uint8)[at[0]:at[-1]]
    return data, at - at[0]


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], object]],
               schema: str) -> DataFrame:
    """`make()` is called once in a task; what it returns turns a slice into columns by name."""

    def run(batches):
        fn = make()
        for batch in slices(batches):
            out = fn(batch)
            if out is not None:
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows of df, all columns as they are, for which `make()(texts)` is true; null texts are empty."""

    def rule():
        fn = make()

        def run(batch):
            texts = batch.column("text").cast(pa.string()).fill_null("")
            return batch.filter(pa.array(np.asarray(fn(texts), bool)))
        return run

    return map_slices(df, rule, df.schema)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column, in any case of letters."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name
