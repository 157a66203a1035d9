import math

import pytest
from pyspark.sql import functions as F

from assaykit.operators import cleaning as C


def _act(spark, rows):
    return spark.createDataFrame(rows, "activity_id long, standard_type string, potential_duplicate long, "
                                       "standard_relation string, standard_units string, standard_value double, "
                                       "pchembl_value double")


def test_drop_incomplete_drops_null_and_nan(spark):
    df = _act(spark, [(1, "IC50", 0, "=", "nM", 10.0, 5.0), (2, "IC50", 0, "=", "nM", float("nan"), 5.0),
                      (3, "IC50", 0, "=", "nM", 10.0, None), (4, None, 0, "=", "nM", 10.0, 5.0)])
    assert [r.activity_id for r in C.drop_incomplete(df).collect()] == [1]
    assert sorted(r.activity_id for r in C.drop_incomplete(df, ["standard_type"]).collect()) == [1, 2, 3]


def test_add_pic_filters_units_and_sign(spark):
    df = _act(spark, [(1, "IC50", 0, "=", "nM", 1000.0, 1.0), (2, "IC50", 0, "=", "uM", 1.0, 1.0),
                      (3, "IC50", 0, "=", "nM", 0.0, 1.0), (4, "IC50", 0, "=", "nM", -5.0, 1.0)])
    rows = C.add_pic(df).collect()
    assert [r.activity_id for r in rows] == [1]
    assert math.isclose(rows[0].pIC, 6.0)


def test_filters(spark):
    df = _act(spark, [(1, "IC50", 0, "=", "nM", 1.0, 1.0), (2, "Kd", 0, "=", "nM", 1.0, 1.0),
                      (3, "Ki", 1, "=", "nM", 1.0, 1.0), (4, "IC50", 0, ">", "nM", 1.0, 1.0)])
    assert sorted(r.activity_id for r in C.filter_activity(df).collect()) == [1, 4]
    assert [r.activity_id for r in C.filter_exact_labels(df).collect()] == [1]


def test_filter_assay_modes(spark):
    df = spark.createDataFrame([(1, "Homo sapiens", 9606), (2, "Homo sapiens", None), (3, "Mus musculus", 10090),
                                (4, "Danio rerio", 9606)], "assay_id long, assay_organism string, assay_tax_id long")
    assert [r.assay_id for r in C.filter_assay(df, mode="and").collect()] == [1]
    got = sorted(r.assay_id for r in C.filter_assay(df, C.EXPLORATION_ORGANISMS, C.EXPLORATION_TAX_IDS, "or").collect())
    assert got == [1, 2, 3, 4]


def test_filter_structures_guarded(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, ""), (3, None)], "molregno long, canonical_smiles string")
    assert [r.molregno for r in C.filter_structures(df).collect()] == [1]
    only_id = df.select("molregno")
    assert C.filter_structures(only_id).count() == 3


def test_finite_only(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "value double")
    assert [r.value for r in C.finite_only(df).collect()] == [1.0]


def test_enforce_schema_try_cast(spark):
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    df = spark.createDataFrame([("1", "2.5"), ("x", "abc")], "a string, b string")
    schema = StructType([StructField("b", DoubleType()), StructField("a", LongType())])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        C.enforce_schema(df, schema).collect()
    rows = C.enforce_schema(df, schema, safe=True).collect()
    assert rows[0] == (2.5, 1) and rows[1] == (None, None)


def test_value_mismatches(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, "nM"), (2, 1.0, 2.0, "nM"), (3, 1.0, 3.0, "M"), (4, None, 1.0, "nM")],
                               "id long, a double, b double, u string")
    assert [r.id for r in C.value_mismatches(df, "a", "b", 0.5).collect()] == [2, 3]
    assert [r.id for r in C.value_mismatches(df, "a", "b", 0.5, "u", "nM").collect()] == [2]


def test_huge_exponent_is_unknown(spark):
    df = spark.createDataFrame([(1.0, "10^99999999999M"), (2.0, "10^-9M")], "value double, units string")
    assert [r.value_nM for r in C.to_nanomolar(df).collect()] == [None, 2.0]
