"""Arrow functions that read a batch in pieces, so that what a worker holds doesn't grow with the rows of a batch."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: A piece ends with the row that brings it to so many characters of input, or with so many rows.
PIECE_CHARS, PIECE_ROWS = 1 << 18, 1000


def _chars(value: object) -> int:
    return len(value) if isinstance(value, (bytes, str)) else sum(map(_chars, value)) if isinstance(value, list) else 0


def pieces(columns: tuple[pa.Array, ...]) -> Iterator[list[tuple]]:
    """The rows of a batch, as many at a time as a piece holds; a longer row is a piece of its own."""
    rows, chars = [], 0
    for at in range(len(columns[0])):
        row = tuple(c[at].as_py() for c in columns)
        rows.append(row)
        chars += sum(map(_chars, row))
        if chars >= PIECE_CHARS or len(rows) >= PIECE_ROWS:
            yield rows
            rows, chars = [], 0
    if rows:
        yield rows


def map_text(fn: Callable[[str], str], column: pa.Array) -> pa.Array:
    """``fn`` of each value of a string column; a piece at a time is read into Python. Nulls stay null."""
    if column.null_count == len(column):
        return pa.nulls(len(column), pa.string())
    return pa.concat_arrays([pa.array([None if x is None else fn(x) for (x,) in rows], pa.string()) for rows in pieces((column,))])


def by_row(fn: Callable, returns: DataType, kind: pa.DataType):
    """An Arrow function of ``fn`` over the values of each row.

    Spark sends batches by their number of rows, however long these are. What ``fn`` makes of a piece is handed over
    before the next one is read.
    """

    @F.arrow_udf(returns)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for rows in pieces(batch if isinstance(batch, tuple) else (batch,)):
                yield pa.array([fn(*row) for row in rows], kind)
            gc.collect()
            pa.default_memory_pool().release_unused()  # workers live on between batches and tasks, and an executor holds several

    return run
