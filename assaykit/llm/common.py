"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.session import ship_package

#: Bytes of rows in one Arrow batch at most, so that very long texts don't fill a worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name (dots and blanks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns an operator is about to write (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch unless the session has a tighter bound; ship the package."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    ship_package(spark)


_kept: list = [None, None]


def kept(key: object, make: Callable[[], object]):
    """The one large table that a Python worker keeps between its tasks.

    Workers are used again by later stages, so another key first lets go of
    the table of the key before and hands its memory back to the system.
    """
    if _kept[0] != key:
        _kept[:] = [None, None]
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _kept[:] = [key, make()]
    return _kept[1]


def free_prefix(df: DataFrame, stem: str) -> str:
    """A prefix that no column of ``df`` starts with, for an operator's passing columns."""
    prefix = f"_{stem}_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def prefixed(fields: T.StructType, prefix: str) -> T.StructType:
    return T.StructType([T.StructField(prefix + f.name, f.dataType, f.nullable) for f in fields.fields])


def append_columns(df: DataFrame, fields: T.StructType,
                   make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Add columns computed per Arrow batch; all input columns pass through untouched.

    ``make`` runs once per task and returns the function from a batch to one
    list (or Arrow array) per new field. An input column that has the name of
    a new one is replaced by it.
    """
    small_batches(df.sparkSession)
    df = without(df, fields.fieldNames())
    schema = T.StructType(list(df.schema.fields) + list(fields.fields))
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                new = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(work(batch), types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column of a batch as strings, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
