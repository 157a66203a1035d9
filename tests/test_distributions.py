import pytest
import numpy as np
from pyspark.sql import functions as F

from assaykit.operators import distributions as D
from assaykit.operators import quantiles as Q


def test_histogram_bins_sum_and_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 10]] + [(None,), (float("nan"),), (float("inf"),)],
                               "x double")
    rows = D.histogram(df, "x", bins=5).collect()
    assert len(rows) == 5 and sum(r.n for r in rows) == 6
    assert rows[0].lo == 0.0 and rows[-1].hi == 10.0
    assert [r.n for r in rows] == [2, 2, 1, 0, 1]  # last bin closed on the right


def test_histogram_empty_and_constant(spark):
    empty = spark.createDataFrame([], "x double")
    assert D.histogram(empty, "x").count() == 0
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    rows = D.histogram(const, "x", bins=4).collect()
    assert [r.n for r in rows] == [2, 0, 0, 0]


def test_grouped_histogram_null_key_is_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "k string, x double")
    rows = D.grouped_histogram(df, "x", ["k"], bins=2).collect()
    got = {(r.k, r.bin): r.n for r in rows}
    assert got == {("a", 0): 1, ("a", 1): 1, (None, 0): 1, (None, 1): 1}


def test_top_groups_ties_by_key(spark):
    df = spark.createDataFrame([(k,) for k in ["b", "a", "c", "c", "d", "d", None, None, None]], "k string")
    top = [(r.k, r.n, r.rank) for r in D.top_groups(df, "k", 3).orderBy("rank").collect()]
    assert top == [("c", 2, 1), ("d", 2, 2), ("a", 1, 3)]
    within = D.top_groups(df.withColumn("g", F.lit(1)), "k", 2, within=["g"]).orderBy("rank").collect()
    assert [(r.k, r.rank) for r in within] == [("c", 1), ("d", 2)]


def test_quantiles_on_empty_input(spark):
    empty = spark.createDataFrame([], "x double")
    row = Q.quantile_bounds(empty, "x", (0.5,), exact=True, names=["m"]).collect()
    assert row == [] or row[0].m is None
    assert Q.iqr_filter(spark.createDataFrame([(1.0,)], "x double"), "x", exact=True).count() == 1


def test_profile_dataset(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "i long, s string")
    rows = {r.column: r for r in D.profile_dataset(df, exact=True).collect()}
    assert (rows["i"].non_null, rows["i"].nulls, rows["i"].distinct_values) == (3, 0, 2)
    assert (rows["s"].non_null, rows["s"].nulls, rows["s"].distinct_values) == (2, 1, 2)
    approx = {r.column: r.distinct_values for r in D.profile_dataset(df).collect()}
    assert approx == {"i": 2, "s": 2}


def test_distributions_against_counting_rows(spark):
    """Weights, NULL keys and types, values that are no numbers, one group with most rows."""
    rng = np.random.default_rng(2)
    rows = [(["IC50", "Ki", None][min(2, i % 7 // 3)], [None, "rat", "man"][i % 3] if i % 5 else "man", int(i % 2) or None,
             [None, float("nan"), float("inf")][i % 3] if i % 11 == 0 else float(rng.integers(0, 40)) / 4, int(i % 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "t string, org string, kind int, x double, w int")
    d = D.activity_distributions(df, "x", ["org", "kind"], within="t", bins=7, weight="w")
    want, values = {}, {}
    for t, org, kind, x, w in rows:
        if x is not None and np.isfinite(x):
            for g in ((t, "overall", None), (t, "org", org), (t, "kind", None if kind is None else str(kind))):
                values.setdefault(g, []).append((x, w))
    for g, xs in values.items():
        lo, hi = min(x for x, _ in xs), max(x for x, _ in xs)
        for x, w in xs:
            b = min(int((x - lo) / ((hi - lo) / 7)), 6) if hi > lo else 0
            want[(*g, b)] = want.get((*g, b), 0) + w
    assert {(r.t, r.dim, r.key, r.bin): r.n for r in d.collect()} == want


def test_distributions_read_counts_not_rows(spark, monkeypatch):
    from assaykit import session

    plans = []
    monkeypatch.setattr(session, "STORED_PLANS", plans)
    df = spark.range(1000).select(F.lit("a").alias("t"), (F.col("id") % 3).alias("k"), (F.col("id") % 10).cast("double").alias("x"))
    out = D.activity_distributions(df, "x", ["k"], within="t", bins=5)
    assert out.agg(F.sum("n")).first()[0] == 2000
    assert plans and not any("Generate" in p for p in plans)
    assert "Expand" in plans[0] and plans[0].index("Expand") < plans[0].rindex("HashAggregate")


def test_profile_query_counts_distinct_values_exactly(spark, tmp_dir):
    """1500 different keys: an estimate or an order of magnitude would not do."""
    from assaykit.plans import catalog

    catalog.load_all()
    spark.range(1500).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 1100).alias("l_partkey"), (F.col("id") % 20).alias("l_suppkey"),
        F.lit(7).alias("l_linenumber"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("l_extendedprice"),
        F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.lit("A").alias("l_returnflag"),
    ).write.parquet(f"{tmp_dir}/lineitem.parquet")
    rows = catalog.QUERIES["profile_dataset"](spark, tmp_dir).collect()
    assert list(rows[0].asDict()) == ["position", "column", "data_type", "non_null", "nulls", "distinct_values"]
    got = {r.column: (r.non_null, r.nulls, r.distinct_values) for r in rows}
    assert len(rows) == len(got) == 13
    assert got["activity_id"] == got["assay_id"] == (1500, 0, 1500) and got["molregno"] == (1500, 0, 1100)
    assert got["standard_value"] == (1000, 500, 1000) and got["pchembl_value"] == (0, 1500, 0) and got["units"] == (1500, 0, 4)
