import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import quantiles as Q
from assaykit.operators.ranking import global_index


@pytest.mark.parametrize("n", [1, 2, 7, 8, 1001])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = np.round(rng.normal(5, 2, n), 2)  # ties on purpose
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(5)
    probs = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)
    row = Q.quantile_bounds(df, "x", probs, exact=True, names=[f"p{i}" for i in range(len(probs))]).collect()[0]
    for i, p in enumerate(probs):
        assert row[i] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9)


def test_exact_quantiles_ignore_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    row = Q.quantile_bounds(df, "x", (0.5,), exact=True, names=["m"]).collect()[0]
    assert row.m == 2.0


def test_exact_quantiles_partition_independent(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 1000).cast("double").alias("x"))
    a = Q.quantile_bounds(df.repartition(3), "x", (0.1, 0.9), exact=True).collect()[0]
    b = Q.quantile_bounds(df.repartition(11), "x", (0.1, 0.9), exact=True).collect()[0]
    assert a == b


def test_iqr_filter_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(0, 1, 500), [15.0, -12.0, 30.0]])
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(vals)], "id long, x double")
    q1, q3 = np.percentile(vals, [25, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    expect = sorted(i for i, v in enumerate(vals) if lo <= v <= hi)
    got = sorted(r.id for r in Q.iqr_filter(df, "x", exact=True).collect())
    assert got == expect


def test_approx_quantiles_close(spark):
    df = spark.range(0, 10000).select(F.col("id").cast("double").alias("x"))
    row = Q.quantile_bounds(df, "x", (0.25, 0.75), exact=False).collect()[0]
    assert abs(row.q25 - 2500) <= 20 and abs(row.q75 - 7500) <= 20


def test_global_index_contiguous(spark):
    df = spark.range(0, 3000).select(((F.col("id") * 104729) % 3001).alias("k")).repartition(7)
    rows = global_index(df, ["k"], "i", num_partitions=5).collect()
    assert sorted(r.i for r in rows) == list(range(3000))
    by_i = sorted(rows, key=lambda r: r.i)
    assert [r.k for r in by_i] == sorted(r.k for r in rows)


def test_global_index_large_post_shuffle_input(spark):
    """Big enough that range sampling is seed dependent, and the input comes out of a shuffle."""
    base = spark.range(0, 200000, numPartitions=4).select((F.col("id") * 7919 % 100003).alias("k"),
                                                          (F.col("id") % 13).alias("g"))
    df = base.groupBy("k").agg(F.sum("g").alias("s"))  # shuffled input, order within partitions not fixed
    n = df.count()
    g = global_index(df, ["k"], "i", num_partitions=8)
    stats = g.agg(F.min("i"), F.max("i"), F.countDistinct("i"), F.count("*")).collect()[0]
    assert tuple(stats) == (0, n - 1, n, n)
    pairs = sorted((r.i, r.k) for r in g.select("i", "k").collect())
    assert [k for _, k in pairs] == sorted(k for _, k in pairs)


def test_group_row_number_matches_window_with_hot_group(spark):
    from pyspark.sql import Window

    from assaykit.operators.ranking import group_row_number

    # group 0 holds a third of the rows; NULL is a group of its own
    df = spark.range(0, 9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 50)
        .alias("g"), ((F.col("id") * 7919) % 10007).alias("t"), F.col("id"))
    got = group_row_number(df, ["g"], ["t", "id"], "rn", num_partitions=6)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")) - 1)
    assert sorted(map(tuple, got.select("id", "rn").collect())) == sorted(map(tuple, ref.select("id", "rn").collect()))


@pytest.mark.parametrize("inclusive", [True, False])
def test_prefix_aggregate_matches_windows(spark, inclusive):
    from pyspark.sql import Window

    from assaykit.operators.ranking import prefix_aggregate

    df = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40).alias("g"),
        F.col("id").alias("t"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(((F.col("id") * 7919) % 1009).cast("double")).alias("x"))
    specs = {"mn": ("min", F.col("x")), "mx": ("max", F.col("x")), "sm": ("sum", F.col("x"))}
    got = prefix_aggregate(df, ["g"], ["t"], specs, inclusive=inclusive, num_partitions=7)
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ref = df.select("t", F.min("x").over(w).alias("mn"), F.max("x").over(w).alias("mx"),
                    F.coalesce(F.sum("x").over(w), F.lit(0.0)).alias("sm"))
    a = sorted(tuple(r) for r in got.select("t", "mn", "mx", "sm").collect())
    b = sorted(tuple(r) for r in ref.collect())
    assert a == b


def test_prefix_aggregate_null_groups_single_block(spark):
    from assaykit.operators.ranking import prefix_aggregate

    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, 3.0), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 1.0)],
                               "g string, t long, x double")
    for parts in (1, 4):
        got = {(r.g, r.t): (r.mn, r.sm) for r in prefix_aggregate(
            df, ["g"], ["t"], {"mn": ("min", F.col("x")), "sm": ("sum", F.col("x"))}, num_partitions=parts).collect()}
        assert got == {(None, 1): (5.0, 5.0), (None, 2): (3.0, 8.0),
                       ("a", 1): (2.0, 2.0), ("a", 2): (2.0, 2.0), ("a", 3): (1.0, 3.0)}


def test_prefix_aggregate_on_a_numbered_frame(spark):
    from assaykit.operators.ranking import number_blocks, prefix_aggregate
    from assaykit.session import stored

    df = spark.range(0, 500).select((F.col("id") % 4).alias("g"), F.col("id").alias("t"),
                                    (F.col("id") % 9).cast("double").alias("x"))
    n = number_blocks(df, ["g"], ["t"])
    a = stored(prefix_aggregate(n, ["g"], ["t"], {"s1": ("sum", F.col("x"))}, numbered=True), "unit")
    b = prefix_aggregate(a, ["g"], ["t"], {"s2": ("sum", F.col("s1"))}, numbered=True)
    direct = prefix_aggregate(prefix_aggregate(df, ["g"], ["t"], {"s1": ("sum", F.col("x"))}),
                              ["g"], ["t"], {"s2": ("sum", F.col("s1"))})
    assert sorted(tuple(r) for r in b.select("t", "s2").collect()) == \
        sorted(tuple(r) for r in direct.select("t", "s2").collect())


def test_columns_of_the_same_name_are_not_taken_for_a_numbering(spark):
    from assaykit.operators.ranking import prefix_aggregate

    df = spark.range(0, 50).select((F.col("id") % 2).alias("g"), F.col("id").alias("t"), F.lit(1.0).alias("x"),
                                   F.lit(0).alias("_gi_other"))
    got = {r.t: r.s for r in prefix_aggregate(df, ["g"], ["t"], {"s": ("sum", F.col("x"))}).collect()}
    assert got == {t: t // 2 + 1 for t in range(50)}


def test_exact_quantiles_count_a_hot_value_once(spark):
    from assaykit.operators.ranking import cumulative_counts

    df = spark.range(0, 20_000).select(F.when(F.col("id") % 10 != 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    rows = cumulative_counts(df, "v").collect()
    assert len(rows) == df.distinct().count()  # what the range shuffle deals: one row per value
    assert max(r.n for r in rows) == 18_000 and max(r.n_before + r.n for r in rows) == 20_000
    import numpy as np

    values = [r.v for r in df.collect()]
    got = Q.quantile_bounds(df, "v", (0.05, 0.25, 0.93), exact=True).first()
    assert list(got) == pytest.approx(list(np.quantile(values, (0.05, 0.25, 0.93))))
