"""Quantile bounds and the IQR fence.

The reference computes q1/q3 with an eager ``approxQuantile`` on the driver.
Here the bounds are a one-row DataFrame and the fence reads them through a
scalar subquery, so the whole job stays one lazy plan and no cross join is
needed.

* ``exact=False`` (default, for very large inputs): a KLL sketch, of a size
  fixed by the rank error, merged from one sketch a task. Sketches of parts of
  the input can be stored and merged later (``operators.sketches``).
* ``exact=True``: linear-interpolated quantiles (SQL ``quantile_cont``) from
  counts per distinct value: the values are counted map-side, the distinct ones
  are range-partitioned and their counts summed up, and the values at the needed
  ranks are picked. A value that most rows hold is one row of that, and no task
  holds all distinct values, unlike the final buffer of Spark's ``percentile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.ranking import cumulative_counts
from assaykit.operators.sketches import quantile_row

IQR_MULTIPLIER = 1.5
QUANTILE_RELATIVE_ERROR = 0.001


def _qname(p: float) -> str:
    return "q" + f"{p:g}".replace("0.", "").replace(".", "_")


def quantile_bounds(df: DataFrame, col: str, probs: Sequence[float] = (0.25, 0.75),
                    accuracy: int | None = None, exact: bool = False,
                    names: Sequence[str] | None = None) -> DataFrame:
    """One row with one column per probability (``q25``, ``q75`` by default)."""
    names = list(names) if names is not None else [_qname(p) for p in probs]
    vals = df.select(F.col(col).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v"))
    if not exact:
        return quantile_row(vals, "v", probs, 1.0 / accuracy if accuracy else QUANTILE_RELATIVE_ERROR, names)

    counted = cumulative_counts(vals, "v")

    def at(rank):  # the value that holds a rank (from 0)
        return F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col("v")))

    aggs, out = [F.max("n_total").alias("_n")], []
    for p, name in zip(probs, names):
        pos = (F.col("n_total") - 1).cast("double") * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"_{name}_lo"), at(F.ceil(pos)).alias(f"_{name}_hi")]
        place = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return counted.agg(*aggs).select(*out)


def iqr_bounds(df: DataFrame, col: str, k: float = IQR_MULTIPLIER, exact: bool = False,
               accuracy: int | None = None) -> DataFrame:
    """One row: q1, q3, lower = q1 - k*iqr, upper = q3 + k*iqr (A3)."""
    q = quantile_bounds(df, col, (0.25, 0.75), accuracy=accuracy, exact=exact, names=("q1", "q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - F.lit(k) * iqr).alias("lower"),
                    (F.col("q3") + F.lit(k) * iqr).alias("upper"))


def iqr_filter(df: DataFrame, col: str = "pIC", k: float = IQR_MULTIPLIER, exact: bool = False,
               accuracy: int | None = None) -> DataFrame:
    """Keep rows with lower <= col <= upper; bounds from ``df`` itself."""
    b = iqr_bounds(df, col, k=k, exact=exact, accuracy=accuracy)
    fence = b.select(F.struct("lower", "upper")).scalar()
    # The bounds struct is bound to one column, so the plan holds a single subquery.
    return (df.withColumn("_fence", fence)
            .where((F.col(col) >= F.col("_fence.lower")) & (F.col(col) <= F.col("_fence.upper")))
            .drop("_fence"))
