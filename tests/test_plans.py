"""Plan checks: no cartesian products, filters reach the Parquet scan, wide arrays are not shuffled."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in
                                        ("fingerprint_baseline", "robust_pooled_regression")))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _physical(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filters_pushed_into_scan(spark, tmp_dir):
    """On physical columns (as in a deployed export) the organism rule reaches the Parquet reader."""
    from assaykit.operators import cleaning as C
    from assaykit.sources import fixtures as fx

    C.project_assay(fx.assay(spark, SF_SMALL)).write.parquet(f"{tmp_dir}/assay")
    df = C.filter_assay(spark.read.parquet(f"{tmp_dir}/assay")).select("assay_id")
    text = _plan(df)
    pushed = text.split("PushedFilters: ")[1].split("]")[0]
    assert "In(assay_organism" in pushed or "EqualTo(assay_organism" in pushed, text
    assert "assay_tax_id" in pushed
    # column pruning: only the filter and output columns are read
    assert text.split("ReadSchema: ")[1].split("\n")[0] == \
        "struct<assay_id:bigint,assay_organism:string,assay_tax_id:bigint>"


def test_flagship_scans_are_pruned(spark):
    text = _plan(entry.entry(spark))
    for scan in text.split("ReadSchema: ")[1:]:
        schema = scan.split("\n")[0]
        assert "l_shipdate" not in schema and "o_totalprice" not in schema and "p_retailprice" not in schema


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["molregno", "activity_id", "canonical_smiles", "pIC", "assay_organism", "split"]
