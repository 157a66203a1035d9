from pyspark.sql import functions as F

from assaykit.operators import distributions as D
from assaykit.operators import joins as J


def _tables(spark):
    m = spark.createDataFrame([(1, 10, 5.0), (2, 20, 6.0), (3, 30, 7.0), (4, 40, 8.0), (5, 10, 5.5)],
                              "activity_id long, tid long, log_value double")
    td = spark.createDataFrame([(10,), (20,), (40,)], "tid long")  # 30 unknown target
    tc = spark.createDataFrame([(10, 100), (10, 101), (10, 102), (40, 103), (30, 100)],
                               "tid long, component_id long")  # 20 has no components
    cs = spark.createDataFrame([(100, "PROTEIN"), (101, "PROTEIN"), (102, "DNA")],
                               "component_id long, component_type string")  # 103 has no sequence
    return m, td, tc, cs


def test_weighted_annotation_reproduces_fanout_counts(spark):
    m, td, tc, cs = _tables(spark)
    fan = J.annotate_targets(m, td, tc, cs)
    w = J.annotate_target_types(m, td, tc, cs)
    a = {(r.activity_id, r.component_type): r.n for r in fan.groupBy("activity_id", "component_type").count()
         .withColumnRenamed("count", "n").collect()}
    b = {(r.activity_id, r.component_type): r.n_components for r in w.collect()}
    assert a == b
    assert b[(1, "PROTEIN")] == 2 and b[(1, "DNA")] == 1 and b[(2, None)] == 1 and b[(3, None)] == 1
    assert b[(4, None)] == 1


def test_weighted_histogram_equals_fanout_histogram(spark):
    m, td, tc, cs = _tables(spark)
    fan = D.activity_distributions(J.annotate_targets(m, td, tc, cs).withColumn("t", F.lit("IC50")),
                                   "log_value", ["component_type"], within="t", bins=4)
    w = D.activity_distributions(J.annotate_target_types(m, td, tc, cs).withColumn("t", F.lit("IC50")),
                                 "log_value", ["component_type"], within="t", bins=4, weight="n_components")
    assert sorted(map(tuple, fan.collect()), key=str) == sorted(map(tuple, w.collect()), key=str)


def test_semi_join_keys_dedupes(spark):
    structs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "molregno long, canonical_smiles string")
    acts = spark.createDataFrame([(1,), (1,), (1,), (3,)], "molregno long")
    out = J.semi_join_keys(structs, acts)
    assert sorted(r.molregno for r in out.collect()) == [1, 3]
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()
