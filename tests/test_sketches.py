"""Stored sketches: error bounds, merging, and days that are read once."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import quantiles as Q
from assaykit.operators import sketches as Sk


@pytest.fixture(scope="module")
def days(spark):
    """30,000 rows over six days; most values of one day are the same; odd values in a few rows."""
    rng = np.random.default_rng(0)
    rows = [(int(i), f"u{i % 700}", float(rng.lognormal()) if i % 6 else 1.0, dt.date(2024, 1, 1 + i % 6)) for i in range(30_000)]
    rows += [(None, None, float("nan"), dt.date(2024, 1, 1)), (7, "u1", None, None), (8, None, float("inf"), dt.date(2024, 1, 2)),
             (9, "u1", float("-inf"), dt.date(2024, 1, 2)), (10, "u2", -0.0, dt.date(2024, 1, 2)), (11, "u2", 0.0, dt.date(2024, 1, 2))]
    return spark.createDataFrame(rows, "id long, who string, value double, day date").repartition(5).cache()


@pytest.mark.parametrize("eps", [0.02, 0.005])
def test_merged_ranks_are_within_the_error(days, eps):
    rows = Sk.sketch_rows(days, F.col("day"), eps, ["id", "value"])
    probs = [i / 20 for i in range(1, 20)]
    got = Sk.rank_errors(days, Sk.merged_quantiles(rows, probs)).collect()
    assert len(got) == 2 * len(probs) and all(r.error <= eps for r in got)
    assert {r.column: r.n for r in got} == {"id": 30_005, "value": 30_004}


def test_rank_error_sees_a_wrong_value(days):
    wrong = days.sparkSession.createDataFrame([("id", 0.5, 3000.0)], "column string, p double, value double")
    assert Sk.rank_errors(days, wrong).first().error == pytest.approx(0.4, abs=0.01)
    assert Sk.rank_errors(days, wrong.where("false")).count() == 0


def test_profile_of_days(days):
    rows = Sk.sketch_rows(days, F.col("day"))
    assert rows.count() == 7 * 4 and rows.where(F.col("part") == Sk.NO_PART).count() == 4
    got = {r.column: r for r in Sk.merged_profile(rows).collect()}
    exact = {r.column: r.distinct_values for r in Sk.distinct_counts(days, days.columns).collect()}
    assert {c: (r.n_rows, r.non_null, r.nulls) for c, r in got.items()} == {
        "id": (30_006, 30_005, 1), "who": (30_006, 30_004, 2), "value": (30_006, 30_005, 1), "day": (30_006, 30_005, 1)}
    assert exact["day"] == 6 and exact["who"] == 700 and got["day"].distinct_values == 6
    for c, n in exact.items():
        assert abs(got[c].distinct_values - n) <= max(1, 0.04 * n), c


def test_a_new_day_reads_no_older_one(spark, days, tmp_dir):
    path = f"{tmp_dir}/sketches"
    assert Sk.stored_parts(spark, path) == []
    first = days.where("day < '2024-01-04'")
    assert Sk.add_parts(first, path, F.col("day")) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    once = {(r.part, r.column): (r.n_rows, bytes(r.hll)) for r in Sk.read_sketches(spark, path).collect()}
    changed = days.withColumn("who", F.when(F.col("day") < "2024-01-04", F.lit("other")).otherwise(F.col("who")))
    assert Sk.add_parts(changed, path, F.col("day")) == ["2024-01-04", "2024-01-05", "2024-01-06", Sk.NO_PART]
    assert Sk.add_parts(days, path, F.col("day")) == []
    after = {(r.part, r.column): (r.n_rows, bytes(r.hll)) for r in Sk.read_sketches(spark, path).collect()}
    assert all(after[k] == v for k, v in once.items()) and len(after) == 7 * 4
    whole = {r.column: r.n_rows for r in Sk.merged_profile(Sk.read_sketches(spark, path)).collect()}
    assert set(whole.values()) == {30_006}


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan"))], "k string, x double")
    assert Sk.merged_quantiles(Sk.sketch_rows(df, F.lit("p")), [0.5]).count() == 0
    assert Q.quantile_bounds(df, "x", (0.5,), names=["m"]).collect()[0].m is None
    with pytest.raises(ValueError, match="between"):
        Sk.kll_size(0.0)


def test_approximate_bounds_use_the_sketch(days):
    row = Q.quantile_bounds(days, "value", (0.25, 0.75), accuracy=200).first()
    x = np.sort([r.value for r in days.select("value").collect() if r.value is not None and not np.isnan(r.value)])
    for p, q in zip((0.25, 0.75), row):
        low, high = np.searchsorted(x, q, "left") / len(x), np.searchsorted(x, q, "right") / len(x)
        assert low - 0.005 <= p <= high + 0.005


def test_exact_profile_multiplies_no_row(days):
    from assaykit.operators.distributions import profile_dataset

    for exact in (False, True):
        plan = profile_dataset(days, exact=exact)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan
