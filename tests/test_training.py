from pyspark.sql import functions as F

from assaykit.operators import structures as S
from assaykit.plans.training import graph_training_labels, training_set
from assaykit.sources import fixtures as fx
from conftest import SF_SMALL


def _tables(spark):
    return fx.activity(spark, SF_SMALL), fx.assay(spark, SF_SMALL), fx.compound_struct(spark, SF_SMALL)


def test_hooks_applied_in_order(spark):
    act, ass, st = _tables(spark)
    seen = []

    def pre(df):
        seen.append("filter")
        assert "pIC" not in df.columns  # runs before the clean step
        return df.where(F.col("standard_type") == "IC50")

    def post(df):
        seen.append("post")
        assert "pIC" in df.columns  # runs after pIC exists
        return df.where(F.col("pIC") > 4.5)

    out = training_set(act, ass, st, activity_filters=[pre], activity_post=[post])
    assert seen == ["filter", "post"]
    assert out.where(F.col("pIC") <= 4.5).count() == 0
    assert out.columns == ["activity_id", "molregno", "canonical_smiles", "pIC", "assay_organism"]


def test_featurise_runs_only_on_eligible_molecules(spark):
    act, ass, st = _tables(spark)
    graphs = training_set(act, ass, st, featurise=lambda s: S.token_graphs(s),
                          feature_cols=("node_features", "edge_index"))
    plain = training_set(act, ass, st)
    assert graphs.count() == plain.count()
    plan = graphs._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan  # structures are pre-filtered before they become graphs


def test_labels_one_row_per_molecule_and_split(spark):
    act, ass, st = _tables(spark)
    out = graph_training_labels(act, ass, st, exact_quantiles=True)
    assert out.count() == out.select("molregno").distinct().count()
    assert {r.split for r in out.select("split").distinct().collect()} <= {"train", "val"}
    approx = graph_training_labels(act, ass, st, exact_quantiles=False)
    assert {r.molregno for r in approx.collect()} == {r.molregno for r in out.collect()}
