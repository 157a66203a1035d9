"""Regression metrics from mergeable sums.

Batch, epoch and run metrics are one ``rollup`` over the per-row sums
(|e|, e^2, y, y^2, n, loss), so each level is exact and no level is an
average of averages: RMSE and R^2 are always recomputed from merged sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.numeric import HUBER_DELTA, huber

R2_SSE_EPSILON = 1e-12


def row_losses(df: DataFrame, pred: str = "pred", label: str = "truth",
               delta: float = HUBER_DELTA) -> DataFrame:
    """Add error, abs_error, squared_error, huber per row."""
    e = F.col(pred) - F.col(label)
    return (df.withColumn("error", e).withColumn("abs_error", F.abs(e))
            .withColumn("squared_error", e * e).withColumn("huber", huber(e, delta)))


def _sum_aggs(pred: str, label: str, delta: float) -> list[Column]:
    e = F.col(pred) - F.col(label)
    y = F.col(label)
    return [
        F.sum(F.abs(e)).alias("abs_error_sum"),
        F.sum(e * e).alias("squared_error_sum"),
        F.sum(y).alias("target_sum"),
        F.sum(y * y).alias("target_squared_sum"),
        F.count(F.lit(1)).alias("n"),
        F.sum(huber(e, delta)).alias("loss_sum"),
    ]


def regression_sums(df: DataFrame, pred: str = "pred", label: str = "truth",
                    by: Sequence[str] = (), delta: float = HUBER_DELTA) -> DataFrame:
    """Σ|e|, Σe², Σy, Σy², n and Σloss, per group."""
    aggs = _sum_aggs(pred, label, delta)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def r2_from_sums(sse: Column, y_sum: Column, y_sq_sum: Column, n: Column) -> Column:
    """R² from sums: NaN for n <= 1; for SST <= 0, 1 if SSE <= 1e-12 else 0 (A10)."""
    nd = n.cast("double")
    sst = y_sq_sum - (y_sum * y_sum) / F.greatest(nd, F.lit(1.0))
    return (F.when(n <= 1, F.lit(float("nan")))
            .when(sst <= 0, F.when(sse <= F.lit(R2_SSE_EPSILON), F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - sse / sst))


def metrics_from_sums(sums: DataFrame) -> DataFrame:
    """Add mae, rmse, r2, loss (size-weighted mean of batch losses) from the sum columns."""
    n = F.col("n").cast("double")
    den = F.greatest(n, F.lit(1.0))
    return (sums.withColumn("mae", F.col("abs_error_sum") / den)
            .withColumn("rmse", F.sqrt(F.col("squared_error_sum") / den))
            .withColumn("mse", F.col("squared_error_sum") / den)
            .withColumn("r2", r2_from_sums(F.col("squared_error_sum"), F.col("target_sum"),
                                           F.col("target_squared_sum"), F.col("n")))
            .withColumn("loss", F.col("loss_sum") / den))


def regression_metrics(df: DataFrame, pred: str = "pred", label: str = "truth",
                       levels: Sequence[str] = ("epoch", "batch_id"),
                       delta: float = HUBER_DELTA) -> DataFrame:
    """Metrics at every prefix of ``levels`` plus the grand total, in one rollup.

    ``level`` is the number of grouping columns in effect (0 = total), so a
    NULL key is never mistaken for a rolled-up row.
    """
    sums = df.rollup(*levels).agg(*_sum_aggs(pred, label, delta),
                                  F.grouping_id(*levels).alias("_gid"))
    depth = F.lit(len(levels)) - F.bit_count(F.col("_gid")).cast("int")
    return metrics_from_sums(sums.withColumn("level", depth).drop("_gid"))


def tensor_stats(df: DataFrame, name: str = "name", values: str = "values") -> DataFrame:
    """Per tensor name: population std and variance, zero fraction, element count."""
    x = df.select(name, F.explode(values).alias("x")).select(name, F.col("x").cast("double").alias("x"))
    return x.groupBy(name).agg(
        F.stddev_pop("x").alias("std"),
        F.var_pop("x").alias("var"),
        F.avg(F.when(F.col("x") == 0, 1.0).otherwise(0.0)).alias("zero_fraction"),
        F.count(F.lit(1)).alias("n_values"),
    )
