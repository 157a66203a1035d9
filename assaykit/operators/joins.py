"""Equi-joins of the bioactivity tables.

No broadcast hints on data-sized sides: AQE turns a join into a broadcast
join only after measuring the side at run time, which is the size check.
Joins are written in the reference's order (selective assay join first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.cleaning import (EXPLORATION_ORGANISMS, EXPLORATION_TAX_IDS,
                                         POTENTIAL_DUPLICATE, filter_assay)


def join_assay(activity: DataFrame, assay: DataFrame, how: str = "inner") -> DataFrame:
    """activity JOIN assay USING (assay_id)."""
    return activity.join(assay, "assay_id", how)


def join_features(df: DataFrame, features: DataFrame, cols: Sequence[str] | None = None,
                  key: str = "molregno") -> DataFrame:
    """Inner join on the molecule key, keeping only ``cols`` of the feature side.

    Molecules that failed featurisation have no feature row, so the inner join
    drops their measurements as in the reference.
    """
    if cols is not None:
        features = features.select(key, *[c for c in cols if c != key])
    return df.join(features, key, "inner")


def semi_join_keys(df: DataFrame, keys_from: DataFrame, key: str = "molregno") -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys_from`` (J3 form; prefilter before costly maps).

    The keys are de-duplicated first; ``distinct`` aggregates map-side, so the
    shuffle carries each key about once per partition instead of once per
    measurement.
    """
    return df.join(keys_from.select(key).distinct(), key, "left_semi")


def measurement_join(activity: DataFrame, assay: DataFrame, standard_type: str | Sequence[str],
                     organisms: Sequence[str] = EXPLORATION_ORGANISMS,
                     tax_ids: Sequence[int] = EXPLORATION_TAX_IDS,
                     duplicate: int = POTENTIAL_DUPLICATE) -> DataFrame:
    """Measurements of one type (or a list) in assays of the chosen species (OR rule)."""
    types = [standard_type] if isinstance(standard_type, str) else list(standard_type)
    act = activity.where(F.col("standard_type").isin(*types)
                         & (F.col("potential_duplicate") == duplicate))
    ass = filter_assay(assay, organisms, tax_ids, mode="or")
    return act.join(ass, "assay_id", "inner")


def annotate_targets(df: DataFrame, target_dictionary: DataFrame, target_components: DataFrame,
                     component_sequences: DataFrame, distinct: bool = False) -> DataFrame:
    """Left-join each measurement to its target's components.

    One output row per component (fan-out preserved, as the reference counts
    a measurement once per component); NULL component_type when the target or
    its components are unknown. ``distinct=True`` keeps one row per input row
    and component type instead.
    """
    td = target_dictionary.select(F.col("tid").alias("_td_tid"))
    tc = target_components.select(F.col("tid").alias("_tc_tid"), F.col("component_id").alias("_tc_cid"))
    cs = component_sequences.select(F.col("component_id").alias("_cs_cid"), "component_type")
    out = (df.join(td, F.col("tid") == F.col("_td_tid"), "left")
           .join(tc, F.col("_tc_tid") == F.col("_td_tid"), "left")
           .join(cs, F.col("_cs_cid") == F.col("_tc_cid"), "left")
           .drop("_td_tid", "_tc_tid", "_tc_cid", "_cs_cid"))
    return out.distinct() if distinct else out


def target_type_weights(target_dictionary: DataFrame, target_components: DataFrame,
                        component_sequences: DataFrame, out: str = "n_components") -> DataFrame:
    """(tid, component_type, n_components): how many fan-out rows a target contributes per type.

    The component table is aggregated before it meets the measurements, so
    the result is dimension-sized (targets x types), not measurements x components.
    """
    td = target_dictionary.select("tid").distinct()
    tc = target_components.select("tid", "component_id")
    cs = component_sequences.select("component_id", "component_type")
    return (td.join(tc, "tid").join(cs, "component_id", "left")
            .groupBy("tid", "component_type").agg(F.count(F.lit(1)).alias(out)))


def annotate_target_types(df: DataFrame, target_dictionary: DataFrame, target_components: DataFrame,
                          component_sequences: DataFrame, out: str = "n_components") -> DataFrame:
    """Weighted form of ``annotate_targets``: one row per measurement and component type.

    ``n_components`` is the number of rows ``annotate_targets`` would emit for
    that pair, so sums of it reproduce every fan-out count exactly while the
    data never grows by the number of components per target.
    """
    w = target_type_weights(target_dictionary, target_components, component_sequences, out)
    return (df.join(w, "tid", "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(1)).cast("bigint")))
