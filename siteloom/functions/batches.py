"""Python functions of texts, a few texts of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of texts that become Python's objects together; a longer text goes alone.
SLICE = 1 << 20


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of rows whose texts take SLICE bytes together."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes + 16), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield at, to - at
        at = to


def by_texts(returns: T.DataType) -> Callable[[Callable], Callable[..., Column]]:
    """Makes a function of a text and other values one of Columns.

    What it returns goes back a slice at a time, so that a worker holds the objects of one slice beside an Arrow batch (64 MB at most unless
    spark.sql.execution.arrow.maxBytesPerBatch says otherwise), not those of a batch's 10,000 pages.
    """
    arrow_type = to_arrow_type(returns)

    def made(f: Callable) -> Callable[..., Column]:
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for b in batches:
                columns = b if isinstance(b, tuple) else (b,)
                for at, n in slices(columns[0]):
                    yield pa.array([f(*row) for row in zip(*(c.slice(at, n).to_numpy(zero_copy_only=False) for c in columns))], arrow_type)

        return F.arrow_udf(run, returns)

    return made
