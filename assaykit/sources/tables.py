"""Scans of the driver's Parquet tables.

Only ``spark.read.parquet`` with the column list the caller needs: Catalyst
prunes the read schema and pushes filters into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _status(spark: SparkSession, path: str):
    """Hadoop's file status of a path in any file system, None where there is nothing."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(jpath) if fs.exists(jpath) else None


def table_path(spark: SparkSession, base: str, name: str) -> str:
    """``{base}/{name}.parquet`` when that exists, else the dataset dir ``{base}/{name}``."""
    single = f"{base.rstrip('/')}/{name}.parquet"
    return single if _status(spark, single) is not None else f"{base.rstrip('/')}/{name}"


def _holds_parquet(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(jpath, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


# Schemas already read from a footer, keyed by (path, modification time): later reads of
# an unchanged table pass the schema and skip the footer-reading job.
_SCHEMAS: dict[tuple[str, int], StructType] = {}


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read one table; fails fast when the location holds no Parquet (S12), in any file system."""
    path = table_path(spark, base, name)
    status = _status(spark, path)
    if status is None or (status.isDirectory() and not _holds_parquet(spark, path)):
        raise FileNotFoundError(f"No parquet files found in {path}")
    key = (path, status.getModificationTime())
    if key in _SCHEMAS:
        return spark.read.schema(_SCHEMAS[key]).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[key] = df.schema
    return df


def load_tables(spark: SparkSession, base: str,
                names: Iterable[str]) -> dict[str, DataFrame]:
    """Lazily open several tables by name."""
    return {name: read_table(spark, base, name) for name in names}
