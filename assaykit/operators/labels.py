"""Per-molecule label aggregation (A1).

Scalars are aggregated first (partial aggregation on the map side, so a
molecule holding a third of all rows costs one small buffer per task), and
wide feature columns are joined back afterwards instead of being shuffled
through the aggregate. ``first`` is replaced by the value of the row with
the smallest id, which does not depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEDIAN_ACCURACY = 10_000


def first_by_id(value: str, id_col: str):
    """Value of the row with the smallest ``id_col`` (ties broken by the value itself)."""
    return F.min(F.struct(F.col(id_col), F.col(value)))[value]


def aggregate_labels(df: DataFrame, key: str = "molregno", label: str = "pIC",
                     id_col: str = "activity_id", keep: Sequence[str] = ("assay_organism",),
                     features: DataFrame | None = None,
                     feature_cols: Sequence[str] = (),
                     accuracy: int = MEDIAN_ACCURACY, count_col: str | None = None) -> DataFrame:
    """One row per ``key``: min id, approximate median label, first-by-id ``keep`` columns.

    ``feature_cols`` already in ``df`` are carried as first-by-id values; when
    ``features`` is given they are joined back from it after the aggregate.
    ``count_col`` adds the number of measurements per key in the same aggregate.
    """
    carried = [c for c in feature_cols if features is None]
    aggs = [F.min(id_col).alias(id_col)]
    aggs += [first_by_id(c, id_col).alias(c) for c in carried]
    aggs.append(F.percentile_approx(label, 0.5, accuracy).alias(label))
    aggs += [first_by_id(c, id_col).alias(c) for c in keep]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    out = df.groupBy(key).agg(*aggs)
    if features is not None and feature_cols:
        out = out.join(features.select(key, *feature_cols), key, "inner")
    return out
