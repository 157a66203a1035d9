"""Stored, mergeable sketches per part of the input: dataset profiles (S11) and quantiles (A2).

A part is, say, a day of input. Each part's columns are summarised once:
row counts, an HLL sketch of the distinct values, and a KLL sketch of the
ranks of numeric columns. The summaries are a small table, one row per part
and column, partitioned by part. A new day adds its rows and reads no older
day; profiles and quantiles of any set of days merge the stored sketches.

NULL values are counted but in no sketch; NaN is a distinct value without a
rank, so it is in no KLL sketch. Rows whose part is NULL belong to the part
named ``__none__``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative standard error 0.8 % of the distinct counts.
HLL_LG_K = 14
NO_PART = "__none__"
_EXACT_TYPES = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def kll_size(rank_error: float) -> int:
    """The KLL parameter k whose rank error stays within ``rank_error`` with 99 % probability (2.296 / k ** 0.9021)."""
    if not 0 < rank_error < 1:
        raise ValueError("a rank error lies between 0 and 1")
    return max(8, min(65_535, math.ceil((2.296 / rank_error) ** (1 / 0.9021))))


def ranked(c: Column) -> Column:
    """The column as double where it has a rank: not NULL and not NaN."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def distinct_sketch(field: T.StructField) -> Column:
    """HLL sketch aggregate of a column; types that sketches don't take are hashed to 64 bits (both zeros alike)."""
    c = F.col(f"`{field.name}`")
    if not isinstance(field.dataType, _EXACT_TYPES):
        plain = c + F.lit(0.0) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else c
        plain = c.cast("string") if isinstance(field.dataType, T.MapType) else plain
        c = F.when(c.isNotNull(), F.xxhash64(plain))
    return F.hll_sketch_agg(c, HLL_LG_K)


def sketch_rows(df: DataFrame, part: Column, rank_error: float = 0.01, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per part and column: part, position, column, data_type, n_rows, non_null, hll, kll (NULL if not numeric).

    One scan and one aggregate with partial sketches, without a row per column.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    k = kll_size(rank_error)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        aggs += [F.count(F.col(f"`{f.name}`")).alias(f"_n{i}"), distinct_sketch(f).alias(f"_h{i}")]
        if isinstance(f.dataType, T.NumericType):
            aggs.append(F.kll_sketch_agg_double(ranked(F.col(f"`{f.name}`")), k).alias(f"_k{i}"))
    wide = df.groupBy(F.coalesce(part.cast("string"), F.lit(NO_PART)).alias("part")).agg(*aggs)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.col("_rows").alias("n_rows"), F.col(f"_n{i}").alias("non_null"), F.col(f"_h{i}").alias("hll"),
                     (F.col(f"_k{i}") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("binary")).alias("kll"))
            for i, f in enumerate(fields)]
    return wide.select("part", F.inline(F.array(*rows)))


def stored_parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the parts that the table at ``path`` has; none if there is no table yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return []
    return [r.part for r in read_sketches(spark, path).select("part").distinct().collect()]


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    schema = ("position int, column string, data_type string, n_rows long, non_null long, hll binary, kll binary, part string")
    return spark.read.schema(schema).parquet(path)


def add_parts(df: DataFrame, path: str, part: Column, rank_error: float = 0.01, columns: Sequence[str] | None = None) -> list[str]:
    """Summarise the parts of ``df`` that the table at ``path`` doesn't have, and append them; returns their names.

    The list of stored parts (one name a day) becomes a filter, which prunes
    the input if it is partitioned by the part. A part is taken as complete
    when it is first seen.
    """
    spark = df.sparkSession
    known = stored_parts(spark, path)
    name = F.coalesce(part.cast("string"), F.lit(NO_PART))
    fresh = df.where(~name.isin(known)) if known else df
    rows = sketch_rows(fresh, part, rank_error, columns)
    rows.repartition("part").write.mode("append").partitionBy("part").parquet(path)
    return sorted(set(stored_parts(spark, path)) - set(known))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """Per column over all parts: position, column, data_type, n_rows, non_null, nulls, distinct_values (estimate)."""
    return sketches.groupBy("position", "column", "data_type").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("non_null").alias("non_null"),
        (F.sum("n_rows") - F.sum("non_null")).alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct_values"))


def merged_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Per numeric column and probability, over all parts: column, p, value (NULL where no value has a rank)."""
    merged = sketches.where(F.col("kll").isNotNull()).groupBy("column").agg(F.kll_merge_agg_double("kll").alias("_k"))
    some = merged.where(F.kll_sketch_get_n_double("_k") > 0)
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("_k", F.lit(float(p))).alias("value"))
                     for p in probs])
    return some.select("column", F.inline(rows))


def quantile_row(df: DataFrame, col: str, probs: Sequence[float], rank_error: float, names: Sequence[str]) -> DataFrame:
    """One row with a quantile of ``col`` per name, from one KLL sketch (partial sketches are merged by Spark)."""
    sketch = df.agg(F.kll_sketch_agg_double(ranked(F.col(col)), kll_size(rank_error)).alias("_k"))
    value = [F.when(F.kll_sketch_get_n_double("_k") > 0, F.kll_sketch_get_quantile_double("_k", F.lit(float(p)))) for p in probs]
    return sketch.select(*[v.alias(n) for v, n in zip(value, names)])


def rank_errors(df: DataFrame, quantiles: DataFrame) -> DataFrame:
    """How far each (column, p, value) is from its rank: column, p, n, error.

    A value holds all ranks from the share of smaller rows to the share of
    smaller and equal ones. The quantiles (one row per column and probability)
    are read to the driver; the data is read once.
    """
    asked = quantiles.collect()
    aggs = []
    for i, r in enumerate(asked):
        x = ranked(F.col(f"`{r.column}`"))
        aggs.append(F.struct(F.lit(r.column).alias("column"), F.lit(r.p).alias("p"), F.count(x).alias("n"),
                             F.count_if(x < r.value).alias("below"), F.count_if(x <= r.value).alias("upto")).alias(f"_{i}"))
    if not aggs:
        return df.sparkSession.createDataFrame([], "column string, p double, n long, error double")
    rows = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(aggs))])))
    error = F.greatest(F.col("below") / F.col("n") - F.col("p"), F.col("p") - F.col("upto") / F.col("n"), F.lit(0.0))
    return rows.select("column", "p", "n", error.alias("error"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct values per column: column, distinct_values. One narrow aggregate a column, so no row is multiplied."""
    out = None
    for c in columns:
        one = df.select(F.col(f"`{c}`").alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.lit(1)).agg(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("distinct_values"))
        out = one if out is None else out.unionByName(one)
    return out
