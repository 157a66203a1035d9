"""Training-set job: the reference's graph/fingerprint export re-expressed as one lazy plan.

Order of steps (it changes results, so it is kept):
type/duplicate filter -> job filter -> structure filter -> featurise ->
null drop + pIC -> post-processing (IQR fence, computed over activity
*before* the organism join) -> assay join -> feature join -> null drop ->
optional per-molecule aggregate -> split column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators import cleaning, joins, labels, quantiles, splits
from assaykit.session import stored

Transform = Callable[[DataFrame], DataFrame]


def training_set(activity: DataFrame, assay: DataFrame, structures: DataFrame,
                 featurise: Transform | None = None,
                 feature_cols: Sequence[str] = ("canonical_smiles",),
                 activity_filters: Sequence[Transform] = (),
                 activity_post: Sequence[Transform] = (),
                 organisms: Sequence[str] = cleaning.ORGANISMS,
                 tax_ids: Sequence[int] = cleaning.TAX_IDS,
                 prefilter_structures: bool = True, join_structures: bool = True) -> DataFrame:
    """Rows (activity_id, molregno, *feature_cols, pIC, assay_organism), no nulls (F6 hooks).

    When ``featurise`` is given, structures are first semi-joined to the
    molecules that still have eligible measurements, because Catalyst cannot
    push a filter through a Python map and featurisation is the costly step.
    ``join_structures=False`` stops after the assay join (callers that
    aggregate per molecule join the features afterwards, see
    ``graph_training_labels``).
    """
    act = cleaning.filter_activity(activity)
    for fn in activity_filters:
        act = act.transform(fn)
    ass = cleaning.filter_assay(assay, organisms, tax_ids, mode="and")
    act = cleaning.preprocess_activity(act)
    for fn in activity_post:
        act = act.transform(fn)
    joined = joins.join_assay(act, ass)
    if not join_structures:
        return cleaning.drop_incomplete(joined.select("activity_id", "molregno", "pIC", "assay_organism"))
    feats = structure_features(structures, featurise, joined if prefilter_structures else None)
    out = (joins.join_features(joined, feats, feature_cols)
           .select("activity_id", "molregno", *feature_cols, "pIC", "assay_organism"))
    return cleaning.drop_incomplete(out)


def structure_features(structures: DataFrame, featurise: Transform | None = None,
                       eligible: DataFrame | None = None) -> DataFrame:
    """Filtered structures, optionally featurised; with ``eligible`` only molecules it contains."""
    struct = cleaning.filter_structures(structures)
    if featurise is None:
        return struct
    if eligible is not None:
        struct = joins.semi_join_keys(struct, eligible, "molregno")
    return struct.transform(featurise)


def graph_training_labels(activity: DataFrame, assay: DataFrame, structures: DataFrame,
                          exact_quantiles: bool = False, val_fraction: float = 0.3,
                          seed: int = 42, label_digits: int | None = None) -> DataFrame:
    """Flagship: one labelled row per molecule with a stable train/val tag.

    IC50 with '=' relation, IQR-fenced pIC, assay organism Homo sapiens/9606,
    median label per molecule, split by a hash of the molecule key.
    """
    base = training_set(
        activity, assay, structures,
        activity_filters=[cleaning.filter_exact_labels],
        activity_post=[lambda df: quantiles.iqr_filter(df, "pIC", exact=exact_quantiles)],
        join_structures=False,
    )
    # The structure join only removes whole molecules, so it runs after the per-molecule
    # aggregate: one row per molecule meets the features instead of one per measurement.
    feats = structure_features(structures).select("molregno", "canonical_smiles")
    agg = labels.aggregate_labels(base, key="molregno", label="pIC", id_col="activity_id",
                                  keep=("assay_organism",), features=feats,
                                  feature_cols=("canonical_smiles",))
    if label_digits is not None:
        agg = agg.withColumn("pIC", F.round("pIC", label_digits))
    agg = agg.select("molregno", "activity_id", "canonical_smiles", "pIC", "assay_organism")
    return splits.with_split(agg, "molregno", val_fraction, seed)


def write_splits(df: DataFrame, base: str, mode: str = "overwrite", split_col: str = "split",
                 layout: str = "partitioned") -> None:
    """Write both splits in one job.

    ``partitioned``: one dataset ``{base}`` partitioned by ``split``;
    ``separate``: ``{base}_train`` and ``{base}_val`` like the reference; the
    plan runs once, into a table partitioned by split, which both are copied from.
    """
    if layout == "partitioned":
        df.write.mode(mode).partitionBy(split_col).parquet(base)
        return
    rows = stored(df, "splits", partition_by=[split_col])
    for name in ("train", "val"):
        rows.where(F.col(split_col) == name).drop(split_col).write.mode(mode).parquet(f"{base}_{name}")
