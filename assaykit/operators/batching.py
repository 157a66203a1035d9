"""Dataset serving: mini-batches, shards and seeded shuffles.

Row positions come from ``global_index`` (range partitioning plus
per-partition offsets), never from a window without a partition key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.ranking import global_index
from assaykit.operators.splits import hash_bucket

LOADER_BATCH_SIZE = 512


def assign_batches(df: DataFrame, order: Sequence[str], batch_size: int = LOADER_BATCH_SIZE,
                   drop_last: bool = True, out: str = "batch_id") -> DataFrame:
    """Fixed-size batches over a total order; the short last batch is dropped by default.

    Adds ``row_index`` (0-based) and ``batch_id`` = row_index // batch_size,
    the same as streaming rows with the remainder carried across files.
    """
    idx = global_index(df, order, "row_index", with_total=True)
    out_df = idx.withColumn(out, F.floor(F.col("row_index") / F.lit(batch_size)).cast("bigint"))
    if drop_last:
        out_df = out_df.where(F.col("row_index") < F.floor(F.col("row_index_total") / batch_size) * batch_size)
    return out_df.drop("row_index_total")


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, out: str = "position") -> DataFrame:
    """A reproducible permutation: position by md5(seed:key), ties by key."""
    bucket = df.withColumn("_bucket", hash_bucket(key, seed))
    return global_index(bucket, ["_bucket", key], out).drop("_bucket")


def assign_shards(df: DataFrame, n_workers: int, out: str = "worker") -> DataFrame:
    """Round-robin files to workers: rank of the sorted file path mod n.

    The file list is one row per input file, so its window is bounded by the
    file count.
    """
    tagged = df.withColumn("_file", F.col("_metadata.file_path"))
    files = tagged.select("_file").distinct()
    ranked = files.withColumn("_rank", F.row_number().over(Window.orderBy("_file")) - 1)
    return (tagged.join(ranked, "_file")
            .withColumn(out, (F.col("_rank") % n_workers).cast("int"))
            .withColumnRenamed("_file", "file_path").drop("_rank"))
