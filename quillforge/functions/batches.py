"""Python over Arrow batches whose memory doesn't grow with the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch between Spark and Python, where the session names no other limit.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows, and characters in them, that are gathered for one batch of results.
ROWS, CHARACTERS = 1 << 15, 4 << 20


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """`df.mapInArrow`, with batches bounded by bytes: bounded by rows alone they grow with the texts."""
    conf = df.sparkSession.conf
    if conf.get(_LIMIT, None) is None:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches as Python values, a few at a time: lists and maps take many times their bytes in Arrow."""
    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 16).columns), strict=True)


def gathered(rows: Iterable[tuple], schema: pa.Schema, characters: Callable[[tuple], int] = lambda _: 0) -> Iterator[pa.RecordBatch]:
    """Batches of the rows, each of so many rows or characters at most (one row may have more)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += characters(row)
        if len(held) >= ROWS or size >= CHARACTERS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
