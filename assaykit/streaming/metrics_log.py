"""Metric log with each input file loaded once (T1, S14), whatever is run again.

``foreachBatch`` may get a batch twice: after a failure, or when a stream is
started again with a new checkpoint. So a load is known by the files it has
read, not by its batch number. A load first writes its rows to a folder of its
own and then its entry, one small file with the names of its input files; only
loads with an entry are read, and files that an entry names are not loaded
again. A load that dies in between leaves a folder that nobody reads.

Rows are dealt by run, with large runs split and small ones put together, so a
load makes about as many files as it has tasks, not one a run. ``compact``
turns many loads into one whose entry replaces theirs.

One writer at a time: two streams into one log could load the same file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from assaykit.functions.numeric import is_finite
from assaykit.streaming.metrics_stream import MAX_FILES_PER_TRIGGER, METRIC_SCHEMA

ENTRY = "load string, files array<string>, replaces array<string>, n_rows long"
_FILE = "_source_file"


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def entries(spark: SparkSession, log: str) -> DataFrame:
    """The entries that count: one row a load that no other load replaces."""
    if not _exists(spark, f"{log}/entries"):
        return spark.createDataFrame([], ENTRY)
    every = spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(f"{log}/entries")
    return every.join(every.select(F.explode("replaces").alias("load")), "load", "left_anti")


def read_log(spark: SparkSession, log: str, schema: StructType = METRIC_SCHEMA) -> DataFrame:
    """All rows of the loads that count."""
    loads = [r.load for r in entries(spark, log).where("n_rows > 0").select("load").collect()]
    if not loads:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{log}/data/{load}" for load in loads])


def _commit(spark: SparkSession, log: str, load: str, files: DataFrame, replaces: list[str], n_rows: int) -> None:
    entry = files.agg(F.collect_list("file").alias("files")).select(
        F.lit(load).alias("load"), "files", F.lit(replaces).cast("array<string>").alias("replaces"), F.lit(n_rows).cast("long").alias("n_rows"))
    entry.coalesce(1).write.parquet(f"{log}/entries/{load}")


def load_once(batch: DataFrame, log: str, run: str = "run_id", file: str = _FILE) -> int:
    """Append the finite metric rows of the files in ``batch`` that the log doesn't have yet; returns the rows written.

    ``file`` is the column with the name of the input file. Names of loaded
    files are joined, not collected, as they grow with the log.
    """
    spark = batch.sparkSession
    known = entries(spark, log).select(F.explode("files").alias(file))
    fresh = batch.join(known, file, "left_anti")
    files = fresh.select(F.col(file).alias("file")).distinct()
    if files.isEmpty():
        return 0
    load = f"{uuid.uuid4().hex}"
    rows = fresh.where(is_finite("value")).drop(file)
    path = f"{log}/data/{load}"
    rows.hint("rebalance", F.col(run)).write.parquet(path)
    n = spark.read.schema(rows.schema).parquet(path).count()
    _commit(spark, log, load, files, [], n)
    return n


def compact(spark: SparkSession, log: str, schema: StructType = METRIC_SCHEMA, run: str = "run_id") -> str | None:
    """Turn all loads into one, sorted by run within its files; the replaced folders go when its entry is written."""
    old = [r.load for r in entries(spark, log).select("load").collect()]
    if len(old) < 2:
        return None
    load = f"{uuid.uuid4().hex}"
    rows = read_log(spark, log, schema)
    n = rows.count()
    if n:
        rows.hint("rebalance", F.col(run)).sortWithinPartitions(run).write.parquet(f"{log}/data/{load}")
    files = entries(spark, log).select(F.explode("files").alias("file"))
    _commit(spark, log, load, files, old, n)
    for folder in old:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/data/{folder}")
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    return load


def stream_to_log(spark: SparkSession, src: str, log: str, checkpoint: str, schema: StructType = METRIC_SCHEMA,
                  available_now: bool = True, processing_time: str | None = None,
                  max_files_per_trigger: int = MAX_FILES_PER_TRIGGER) -> StreamingQuery:
    """Start the stream of metric files ``src`` (Parquet) into the log. A batch that fails stops the query."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .option("recursiveFileLookup", "true").parquet(src).withColumn(_FILE, F.col("_metadata.file_path")))
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: load_once(batch, log) and None)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
