"""Counts, histograms and per-group distributions.

Histogram ranges come from one aggregate (a scalar subquery for a single
histogram, a small per-group table for grouped ones), never from a window over
a whole group, so the 'overall' group does not end up in one task. Grouped
histograms and distributions count equal values first and read only counts
from then on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.sketches import distinct_counts, distinct_sketch

HIST_BINS = 100
TOP_N = 6


def count_by(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per key combination (A4)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def row_count(df: DataFrame, out: str = "n_rows") -> DataFrame:
    """Row count as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias(out))


def filter_report(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Row counts after each of several filters, applied one after the other, in one scan (A5)."""
    kept, aggs = F.lit(True), []
    for i, test in enumerate(stages.values()):
        kept = kept & F.coalesce(test, F.lit(False))
        aggs.append(F.count_if(kept).alias(f"_s{i}"))
    rows = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"_s{i}").alias("n_rows"))
                     for i, name in enumerate(stages)])
    return df.agg(*aggs).select(F.inline(rows))


def cleaning_report(stages: Mapping[str, DataFrame]) -> DataFrame:
    """One row per named stage with its row count (A5); counts should shrink."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(i).alias("stage_no"),
                                                            F.lit(name).alias("stage"), "n_rows")
             for i, (name, df) in enumerate(stages.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_dataset(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column: type, non-null count, null count, distinct count.

    One scan. ``exact=False`` uses an HLL sketch (fixed memory per column, and
    exact for few values); ``exact=True`` counts the distinct values of each column on its own, so
    that no row is multiplied by the number of columns: give a stored table.
    ``operators.sketches`` keeps profiles per part of the input.
    """
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for field in df.schema.fields:
        c = field.name
        aggs.append(F.count(F.col(c)).alias(f"nn_{c}"))
        distinct = F.lit(None) if exact else F.hll_sketch_estimate(distinct_sketch(field))
        aggs.append(distinct.cast("bigint").alias(f"nd_{c}"))
    wide = df.agg(*aggs)
    types = dict(df.dtypes)
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(types[c]).alias("data_type"),
                 F.col(f"nn_{c}").alias("non_null"), (F.col("_rows") - F.col(f"nn_{c}")).alias("nulls"),
                 F.col(f"nd_{c}").alias("distinct_values"))
        for i, c in enumerate(df.columns)])
    out = wide.select(F.inline(rows))
    return out if not exact else out.drop("distinct_values").join(distinct_counts(df, df.columns), "column").select(out.columns)


def _bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin in [0, bins), last bin closed; a constant group goes to bin 0."""
    width = (hi - lo) / F.lit(bins)
    raw = F.floor((x - lo) / width)
    return F.when(hi > lo, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0)).cast("bigint")


def _finite(c: Column) -> Column:
    # NaN sorts above every number in Spark and +-inf has no bin width: both are left out.
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """All ``bins`` equal-width bins over min..max of ``col``: bin, lo, hi, n.

    NULL, NaN and infinite values are not counted; an empty input gives no rows.
    """
    vals = df.select(F.col(col).cast("double").alias("x")).where(_finite(F.col("x")))
    rng = vals.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    counts = (vals.select(_bin_index(F.col("x"), rng["lo"], rng["hi"], bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    edges = vals.sparkSession.range(bins).select(F.col("id").alias("bin"))
    width = (rng["hi"] - rng["lo"]) / F.lit(bins)
    return (edges.join(counts, "bin", "left")
            .select("bin", (rng["lo"] + F.col("bin") * width).alias("lo"),
                    (rng["lo"] + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
            .where(rng["lo"].isNotNull()))


def _binned(counted: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Non-empty bins per group from stored counts (by, x, _n), each group over its own min..max.

    The ranges are one row a group, written, so that Spark knows their size
    and sends them to the tasks only where they are small.
    """
    from assaykit.session import stored

    rk = [f"_rk{i}" for i in range(len(by))]
    ranges = stored(counted.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select(
        *[F.col(k).alias(r) for k, r in zip(by, rk)], "lo", "hi"), "ranges")
    # NULL keys are groups too, hence the null-safe equality.
    joined = counted.join(ranges, [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(by, rk)], "inner").drop(*rk)
    binned = joined.withColumn("bin", _bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return (binned.groupBy(*by, "bin", "lo", "hi").agg(F.sum("_n").alias("n"))
            .select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), "n"))


def grouped_histogram(df: DataFrame, col: str, by: Sequence[str], bins: int = HIST_BINS, weight: str | None = None) -> DataFrame:
    """Non-empty bins per group, each group over its own min..max.

    Rows become counts per group and value first (map-side), written once;
    ranges and bins both come from these. ``weight`` names a row multiplicity
    column; counts are then its sum.
    """
    from assaykit.session import stored

    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    vals = df.select(*by, F.col(col).cast("double").alias("x"), w.alias("_w")).where(_finite(F.col("x")))
    return _binned(stored(vals.groupBy(*by, "x").agg(F.sum("_w").alias("_n")), "counts"), by, bins)


def activity_distributions(df: DataFrame, value: str, dims: Sequence[str],
                           within: str = "standard_type", bins: int = HIST_BINS,
                           distinct_measurements: bool = False,
                           id_col: str = "activity_id", weight: str | None = None) -> DataFrame:
    """Overall and per-dimension histograms in one scan.

    Rows are counted per (within, dims, value) first; GROUPING SETS over these
    counts give every (within, dim, key) group its values ('overall' plus one
    grouping per ``dims`` column), from which ranges and bins come. A NULL key
    is a real group, told apart from the overall one by ``dim``.
    ``distinct_measurements`` drops the join fan-out (one row per measurement
    and key) before counting. ``weight`` is a multiplicity column (see
    ``joins.annotate_target_types``): counts become its sum.
    """
    from assaykit.session import stored

    if distinct_measurements and weight:
        raise ValueError("distinct_measurements counts each measurement once; drop the weight")
    x, w = F.col(value).cast("double").alias("x"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w")
    keys = [within, "x"]
    # The value is part of the key: ids may repeat across measurements, and keeping an
    # arbitrary one of them would make the counts depend on row order.
    ids = [id_col] if distinct_measurements else []
    rows = df.select(within, x, *dims, w, *ids).where(_finite(F.col("x")))
    counted = rows.groupBy(*keys, *dims, *ids).agg(F.sum("_w").alias("_w"))
    sets = counted.groupingSets([[*keys, *ids], *([*keys, d, *ids] for d in dims)], *keys, *dims, *ids).agg(
        F.sum("_w").alias("_n"), *[F.grouping(d).alias(f"_g{i}") for i, d in enumerate(dims)])
    dim, key = F.lit("overall"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        dim, key = F.when(F.col(f"_g{i}") == 0, F.lit(d)).otherwise(dim), F.when(F.col(f"_g{i}") == 0, F.col(d).cast("string")).otherwise(key)
    groups = sets.select(within, dim.alias("dim"), key.alias("key"), "x", "_n")
    if distinct_measurements:
        groups = groups.groupBy(within, "dim", "key", "x").agg(F.count(F.lit(1)).alias("_n"))
    return _binned(stored(groups, "counts"), [within, "dim", "key"], bins)


def top_groups(df: DataFrame, key: str, n: int = TOP_N, within: Sequence[str] = (),
               out: str = "n", weight: str | None = None) -> DataFrame:
    """The ``n`` largest groups of ``key`` (NULL key excluded), ties by key.

    The window runs over the per-group counts, not over rows. ``weight`` is a
    row multiplicity column whose sum is the group size.
    """
    size = F.sum(F.col(weight).cast("bigint")) if weight else F.count(F.lit(1))
    counts = df.where(F.col(key).isNotNull()).groupBy(*within, key).agg(size.alias(out))
    order = [F.col(out).desc(), F.col(key).asc()]
    if not within:
        # Distributed top-k (per-partition top n, then merge); the window sees n rows.
        top = counts.orderBy(*order).limit(n)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    # row_number <= n is planned with a per-partition group limit before the shuffle.
    w = Window.partitionBy(*within).orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
