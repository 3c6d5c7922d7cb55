"""Helpers shared by the operators: inputs, held-out split, scratch tables, bounded bitmaps."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gauntlet.session import scratch_dir, ship_package

BITMAP_BITS = 26      # 2**26 bits: 8 MB, whatever the input
SLICE_BITS = 20       # bits of one slice of a bitmap
ROW_KEY = "_row_key"
#: For queries whose result is kept elsewhere: their shuffle files go as soon as they end, not when the driver collects
#: garbage, and what a Python worker gets at a time is bounded in bytes, as 10000 long texts are not small.
OWN_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

#: Paths of the tables materialised by the innermost ``written`` function that is running.
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True for rows that nothing may be learned from; a null id is not held out."""
    return F.coalesce(id_remainder(column, modulus) == remainder, F.lit(False))


@contextmanager
def own_settings(spark: SparkSession) -> Iterator[None]:
    """``OWN_SETTINGS`` hold for the queries run within it."""
    before = {key: spark.conf.get(key, None) for key in OWN_SETTINGS}
    for key, value in OWN_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared scratch folder and read it back.

    This cuts lineage: a lost executor re-reads the table instead of running
    the jobs before it again.  So the shuffle files of those jobs are not kept.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    if (tables := _tables.get()) is not None:
        tables.append(path)
    with own_settings(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(label: str):
    """A function whose result is materialised; then the tables go that it materialised on the way, as nothing reads them.

    Of a tuple, the first is the result, and the others are returned as they are.
    """

    def wrap(fn):
        @wraps(fn)
        def run(*args, **kwargs):
            tables: list[str] = []
            token = _tables.set(tables)
            try:
                result = fn(*args, **kwargs)
            finally:
                _tables.reset(token)
            result, *more = result if isinstance(result, tuple) else (result,)
            out = materialise(result, label)
            sc = out.sparkSession.sparkContext
            for path in tables:
                at = sc._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
            return (out, *more) if more else out
        return run

    return wrap


def bitmap(keys: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap with the bit ``key mod 2**bits`` set for every non-null long of the one column.

    Built by slices in tasks (a slice has 2**20 bits however many keys there
    are), so at most 2**bits / 8 bytes reach the driver.  It has no false
    negatives; false positives only cost later work.
    """
    (name,) = keys.columns
    slots = keys.where(F.col(name).isNotNull()).select(
        F.expr(f"pmod(`{name}`, {1 << bits})").alias("slot")).distinct()
    slots = slots.select(F.shiftright("slot", SLICE_BITS).cast("int").alias("slice"),
                         F.col("slot").bitwiseAND((1 << SLICE_BITS) - 1).cast("int").alias("at"))

    def fill(table: pa.Table) -> pa.Table:
        marks = np.zeros(1 << SLICE_BITS, dtype=bool)
        marks[table.column("at").to_numpy()] = True
        return pa.table({"slice": table.column("slice").slice(0, 1),
                         "packed": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    step = (1 << SLICE_BITS) // 8
    with own_settings(keys.sparkSession):
        slices = slots.groupBy("slice").applyInArrow(fill, "slice int, packed binary").collect()
    for row in slices:
        out[row["slice"] * step:(row["slice"] + 1) * step] = np.frombuffer(row["packed"], np.uint8)
    return out


def in_bitmap(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys (signed or not) may be in the bitmap."""
    slot = np.ascontiguousarray(keys).view(np.uint64) & np.uint64(len(marks) * 8 - 1)
    return (marks[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def of_documents(batches: Iterator[pa.RecordBatch], marks: np.ndarray, nulls: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows whose doc_id may be in the bitmap; those without an id only with ``nulls``.

    For use at the start of a function over batches, where ``maybe_among`` before it would take a second worker.
    """
    for batch in batches:
        ids = batch.column("doc_id")
        held = in_bitmap(marks, ids.fill_null(0).to_numpy())
        none = ids.is_null().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(np.where(none, nulls, held)))


def maybe_among(keys: DataFrame, column: str) -> Column:
    """False only for rows whose id is null or certainly not among the longs of the one column."""
    marks = keys.sparkSession.sparkContext.broadcast(bitmap(keys))

    @F.pandas_udf("boolean")
    def held(ids: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(marks.value, ids.to_numpy(np.int64)))

    own = F.col(column).cast("long")
    return own.isNotNull() & held(F.coalesce(own, F.lit(0)))


def lean(run):
    """A function over batches that gives freed memory back to the system at its end.

    Workers wait for their next task with what their allocators keep, and an executor has several of them.
    """

    @wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return own


def fresh_name(base: str, *tables: DataFrame) -> str:
    """A column name that no column of the tables has (names are compared without case, as Spark does)."""
    taken = {column.lower() for table in tables for column in table.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is not in ``ids`` (one column), with their columns as they are.

    Only documents that may be among the ids are shuffled for the join.
    """
    name = fresh_name("_gone", docs)
    gone = materialise(ids.toDF(name).distinct(), "dropped-ids")
    held = maybe_among(gone, id_col)
    judged = docs.where(held).join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
    return docs.where(~held).unionByName(judged)


def with_row_keys(docs: DataFrame, id_col: str = "doc_id", key: str = ROW_KEY) -> DataFrame:
    """The documents with a key of their own for each row in the column ``key``, in the order of their ids.

    ``key`` must be the name of no column yet (``fresh_name``).

    Where every row has an id of its own, that is the key.  Else rows are numbered by id, those that repeat an id
    after the first one and those without an id last, in a scratch table that all later reads share.
    """
    own = F.col(id_col).cast("long")
    odd = docs.select(own.alias("id")).groupBy("id").count().where("id IS NULL OR count > 1")
    if odd.isEmpty():
        return docs.withColumn(key, own)
    row = fresh_name("_row", docs)
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    keys = rows.select(own.alias(f"{row}_id"), row).orderBy(F.col(f"{row}_id").asc_nulls_last(), row).select(
        row, F.monotonically_increasing_id().alias(key))
    return materialise(rows.join(materialise(keys, "row-keys"), row).drop(row), "keyed-rows")


def by_row_key(rows: DataFrame, id_col: str = "doc_id", key: str = ROW_KEY) -> DataFrame:
    """The documents with the row key in the place of their id."""
    return rows.withColumn(id_col, F.col(key)).drop(key)


def batches_of(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.cast(schema).to_batches()


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
