"""Continuous metric log.

The reference drains an in-process queue of (name, value, step) items in
small batches and ships them to a tracking server. The Spark form is a
Structured Streaming job: new metric files land in a folder, non-finite
values are dropped, and rows are appended to a Parquet table partitioned by
run: into a bounded number of folders, as in ``io.append_metrics``, because
with a folder a run each micro-batch would write as many files as it has runs.
The checkpoint makes the job restartable with exactly-once output; a failing
batch stops the query and the error surfaces to the caller.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from assaykit.functions.numeric import is_finite
from assaykit.sources.io import RUN_PART, RUN_PARTS, run_part

METRIC_SCHEMA = StructType([
    StructField("run_id", LongType()),
    StructField("name", StringType()),
    StructField("value", DoubleType()),
    StructField("step", LongType()),
    StructField("ts", TimestampType()),
])
MAX_FILES_PER_TRIGGER = 64


def stream_metrics(spark: SparkSession, src: str, dst: str, checkpoint: str,
                   schema: StructType = METRIC_SCHEMA, available_now: bool = True,
                   processing_time: str | None = None,
                   max_files_per_trigger: int = MAX_FILES_PER_TRIGGER,
                   parts: int | None = RUN_PARTS) -> StreamingQuery:
    """Start the metric stream ``src`` (Parquet files) -> ``dst`` (Parquet, by ``run_part`` of run_id).

    ``parts=None`` makes a folder a run, for a ``dst`` that has this form already.

    ``available_now`` processes everything present and stops (a batch-style
    catch-up run); otherwise ``processing_time`` sets a periodic trigger.
    """
    stream = (spark.readStream.schema(schema)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(src)
              .where(is_finite("value")))
    if parts is not None:
        stream = stream.withColumn(RUN_PART, run_part(F.col("run_id"), parts))
    writer = (stream.writeStream.format("parquet")
              .option("checkpointLocation", checkpoint)
              .partitionBy("run_id" if parts is None else RUN_PART)
              .outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start(dst)
