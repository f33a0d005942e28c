"""Helpers shared by the operators: text batches as byte arrays, hashing, sampling, lineage."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Most bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on one machine alone, where it is unset, one made here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or str(sc.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the frame that reads it, so that a lost executor
    costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of any file system that Spark reads; nothing happens where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give memory that is free back to the system: workers live on between tasks, and an executor holds several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another libc


def releasing(run: Run) -> Run:
    """``run`` for ``mapInArrow``, which releases memory when a task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = (h ^ (h >> U64(30))) * _MIX1
    h = (h ^ (h >> U64(27))) * _MIX2
    return h ^ (h >> U64(31))


def text_steps(column: pa.Array, most: int = STEP_BYTES, most_rows: int = 20_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column as ``(first row, end row, bytes, offsets)``.

    ``offsets`` has a leading 0 and one end per row; a null text counts as an empty one. A run holds
    at most ``most`` bytes, unless one row alone is longer, and at most ``most_rows`` rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if not rows:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = min(lo + most_rows, max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column out of the values of all rows and how many each row has."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def hashed_sample(df: DataFrame, key: str, group: str, most: int, seed: int = 7) -> DataFrame:
    """Rows whose hashed ``key`` falls under a bar set for each value of ``group``.

    The bar is ``most`` over the group's rows, so about ``most`` rows of each come; which ones depends
    on nothing but the keys. One narrow aggregation counts the groups, whose number must be small.
    """
    sizes = {r[group]: r["n"] for r in df.groupBy(group).agg(F.count("*").alias("n")).collect() if r[group] is not None}
    bar = F.lit(None).cast("double")
    for value, n in sorted(sizes.items(), key=lambda x: str(x[0])):
        bar = F.when(F.col(group) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(bar)
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.filter(place < bar) if sizes else df.filter(F.lit(False))


#: Bytes of rows up to which a side of a join is broadcast.
BROADCAST_BYTES = 16 << 20


def broadcast_small(rows: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` marked for broadcast if they hold at most ``most`` bytes, else as they are, for a shuffled join.

    Bytes are the rows' number times their width, so all columns must be of fixed width; counting runs the rows
    once, so they should be written ones (:func:`cut`).
    """
    width = 16
    for field in rows.schema:
        if isinstance(field.dataType, (StringType, BinaryType, ArrayType, MapType, StructType)):
            raise TypeError(f"{field.name} has no fixed width")
        width += 8
    return F.broadcast(rows) if rows.count() * width <= most else rows


def ranked(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, counted from 0 within each ``key`` by ``order``, written to the shared folder.

    A key with very many rows is ranked in many tasks: rows are sorted by range, each range ranks its own, and what
    the ranges before hold of the key is added. Rows that are equal in ``order`` should be few.
    """
    placed = cut(rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy(key, "_range").orderBy(*order)).cast("long") - 1
    both = placed.withColumn("_own", own).join(counts.select(key, "_range", before.alias("_before")), [key, "_range"])
    return both.withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")
