"""Partition-independent sampling and train/validation splits.

``DataFrame.sample`` draws per partition, so the chosen ids change with the
partition count, and the reference evaluates the plan once per output. Here
membership is a pure function of (seed, key): the first 32 bits of
``md5("{seed}:{key}")`` read as an unsigned integer and compared with
``fraction * 2^32``. Both splits are filters on that column (no join, no
second pass over the data), every row of a key lands on the same side, and
a recomputed partition gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296


def hash_bucket(key: str | Column, seed: int) -> Column:
    """Unsigned 32-bit bucket in [0, 2^32) of ``md5(seed:key)``."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def in_sample(key: str | Column, fraction: float, seed: int) -> Column:
    """Whether a key is in the sample; a NULL key never is, so both sides of a split keep all rows."""
    return F.coalesce(hash_bucket(key, seed) < F.lit(int(round(fraction * TWO_POW_32))), F.lit(False))


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Rows whose key falls in the sample (X1). Same keys for any partitioning."""
    return df.where(in_sample(key, fraction, seed))


def with_split(df: DataFrame, key: str, fraction: float, seed: int = 42,
               col: str = "split") -> DataFrame:
    """Add ``split`` = 'val' or 'train' (X2, X3). Write once with ``partitionBy(split)``."""
    return df.withColumn(col, F.when(in_sample(key, fraction, seed), F.lit("val"))
                         .otherwise(F.lit("train")))


def train_val_split(df: DataFrame, key: str = "activity_id", fraction: float = 0.2,
                    seed: int = 42, val_ids: DataFrame | None = None,
                    cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, val), disjoint and complete over ``key``.

    With ``val_ids`` (a caller-chosen id list) the reference's semi/anti join
    form is used instead of the hash rule (J3, J4).
    """
    if val_ids is not None:
        ids = val_ids.select(key).distinct()
        val = df.join(ids, key, "left_semi")
        train = df.join(ids, key, "left_anti")
    else:
        member = in_sample(key, fraction, seed)
        val = df.where(member)
        train = df.where(~member)
    if cols is not None:
        train, val = train.select(*cols), val.select(*cols)
    return train, val
