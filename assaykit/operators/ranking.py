"""Distributed global row positions without a single-partition window.

``global_index`` numbers rows 0..n-1 in a total order the way ``zipWithIndex``
does, but with DataFrame operations only:

1. range-partition on the order keys (an explicit partition count, so AQE
   never coalesces it), sort inside each partition, and tag every row with its
   partition and its place there (``monotonically_increasing_id`` minus the
   partition's base);
2. write that once, as Parquet, to the session's shared folder
   (``session.stored``; this runs when the plan is built). Both passes below
   read the same files: a range partitioner samples its bounds with a seed tied
   to the RDD, so two separately planned range shuffles of the same data can
   disagree. The copy also means a lost executor never changes the numbering,
   and later reads take only the columns they need;
3. a per-partition row count (one row per partition, bounded by the
   partition count and not by the data) gives each partition its offset,
   which is broadcast back.

Callers must give a total order (add a unique tiebreaker) when the position
of tied rows matters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.session import stored


def _partition_count(df: DataFrame) -> int:
    spark = df.sparkSession
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _running_totals(sizes: DataFrame) -> DataFrame:
    """_pid, _offset (sum of _n before) and _sum: one row per partition, so the windows see no more than that."""
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_sum"))


def cumulative_counts(df: DataFrame, value: str) -> DataFrame:
    """One row per distinct ``value``: n, n_before (rows of smaller values) and n_total.

    Values are counted first (map-side), so a value that most rows hold is one
    row here, and the range shuffle deals distinct values.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts.repartitionByRange(_partition_count(df), value).withColumn("_pid", F.spark_partition_id()), "counts")
    offsets = _running_totals(ranged.groupBy("_pid").agg(F.sum("n").alias("_n")))
    before = Window.partitionBy("_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_local", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .join(F.broadcast(offsets), "_pid")
            .select(value, "n", (F.col("_offset") + F.col("_local")).alias("n_before"), F.col("_sum").alias("n_total")))


def global_index(df: DataFrame, order: Sequence[str | Column], out: str = "row_index",
                 num_partitions: int | None = None, with_total: bool = False):
    """Add a 0-based ``out`` column following ``order`` (ascending).

    With ``with_total`` a ``{out}_total`` column carries the row count,
    summed from the per-partition sizes (no extra scan).
    """
    n_parts = num_partitions or _partition_count(df)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    tagged = stored(ranged.withColumn("_pid", F.spark_partition_id())
                    .withColumn("_local", F.monotonically_increasing_id()
                                - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)), "index")
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _running_totals(sizes).withColumnRenamed("_sum", f"{out}_total")
    indexed = (tagged.join(F.broadcast(offsets), "_pid")
               .withColumn(out, (F.col("_offset") + F.col("_local")).cast("bigint"))
               .drop("_pid", "_local", "_offset"))
    return indexed if with_total else indexed.drop(f"{out}_total")


def group_row_number(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                     out: str = "row_number", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its group, in ``order``, without a per-group window.

    ``row_number() over (partition by group order by ...)`` sends a whole group
    to one task; a group holding a third of the data would then run on one
    core. Here the rows are numbered once in the total order (group keys,
    then ``order``) with ``global_index``, so a large group is spread over
    many range partitions, and the group's first position (a partially
    aggregated ``min`` per group) is subtracted.
    """
    keys = [F.col(g) for g in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    indexed = global_index(df, keys, "_gi", num_partitions)
    starts = indexed.groupBy(*group).agg(F.min("_gi").alias("_g0"))
    joined = indexed.join(starts.select(*[F.col(g).alias(f"_k_{g}") for g in group], "_g0"),
                          [F.col(g).eqNullSafe(F.col(f"_k_{g}")) for g in group])
    return (joined.withColumn(out, (F.col("_gi") - F.col("_g0")).cast("bigint"))
            .drop("_gi", "_g0", *[f"_k_{g}" for g in group]))


_COMBINE = {
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def number_blocks(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                  num_partitions: int | None = None) -> DataFrame:
    """``df`` with _gi (place in the order of group and order) and _blk (equal blocks of it), for several scans."""
    n_parts = num_partitions or _partition_count(df)
    keys = [F.col(g) for g in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    idx = global_index(df, keys, "_gi", n_parts, with_total=True)
    block_size = F.greatest(F.ceil(F.col("_gi_total") / F.lit(n_parts)), F.lit(1))
    return idx.withColumn("_blk", F.floor(F.col("_gi") / block_size)).drop("_gi_total")


def prefix_aggregate(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                     specs: dict[str, tuple[str, Column]], inclusive: bool = True,
                     num_partitions: int | None = None, numbered: bool = False) -> DataFrame:
    """Running min / max / sum per group in ``order`` as a distributed segmented scan.

    ``specs`` maps an output name to (``"min"``|``"max"``|``"sum"``, value column);
    NULL values are ignored. ``inclusive=False`` excludes the current row.

    A running window per group sends the whole group to one task. Instead the
    rows are numbered in (group, order) with ``global_index`` and cut into
    ``num_partitions`` blocks of equal size; each (block, group) piece is
    scanned locally, and the totals of earlier blocks of the same group (a
    table with at most blocks + groups rows) are carried in. A group holding a
    third of the data is therefore scanned by a third of the tasks.

    ``numbered=True`` says that ``df`` comes from ``number_blocks`` (or from a
    scan of such a frame) for this very group and order; the numbering is then
    used, and kept for the next scan. Each scan reads its input twice (rows and
    block totals), so store the frame between chained scans.
    """
    vals = df
    for name, (_, col) in specs.items():
        vals = vals.withColumn(f"_v_{name}", col)
    t = vals if numbered else number_blocks(vals, group, order, num_partitions)
    frame = (Window.partitionBy("_blk", *group).orderBy("_gi")
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    for name, (fn, _) in specs.items():
        t = t.withColumn(f"_l_{name}", _COMBINE[fn][0](f"_v_{name}").over(frame))
    totals = t.groupBy("_blk", *group).agg(*[_COMBINE[fn][0](f"_v_{name}").alias(f"_t_{name}")
                                            for name, (fn, _) in specs.items()])
    before = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_blk", *[F.col(g).alias(f"_k_{g}") for g in group],
                          *[_COMBINE[fn][0](f"_t_{name}").over(before).alias(f"_c_{name}")
                            for name, (fn, _) in specs.items()])
    joined = t.join(carry, [t["_blk"] == carry["_blk"]] + [F.col(g).eqNullSafe(F.col(f"_k_{g}")) for g in group])
    out = joined.drop(carry["_blk"])
    for name, (fn, _) in specs.items():
        out = out.withColumn(name, _COMBINE[fn][1](F.col(f"_c_{name}"), F.col(f"_l_{name}")))
    drop = ([] if numbered else ["_gi", "_blk"]) + [f"_k_{g}" for g in group]
    drop += [f"_{p}_{name}" for name in specs for p in ("v", "l", "c")]
    return out.drop(*drop)
