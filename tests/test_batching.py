import pytest
from pyspark.sql import functions as F

from assaykit.operators import batching as B


@pytest.mark.parametrize("n,size,drop", [(100, 10, True), (103, 10, True), (103, 10, False), (7, 10, True)])
def test_assign_batches(spark, n, size, drop):
    df = spark.range(0, n).select(((F.col("id") * 37) % 1009).alias("k")).repartition(4)
    rows = B.assign_batches(df, ["k"], size, drop_last=drop).collect()
    keys = sorted(r.k for r in df.collect())
    keep = (n // size) * size if drop else n
    assert sorted((r.row_index, r.k, r.batch_id) for r in rows) == [(i, keys[i], i // size) for i in range(keep)]


def test_assign_batches_partition_independent(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    a = sorted(tuple(r) for r in B.assign_batches(df.repartition(2), ["k"], 64).collect())
    b = sorted(tuple(r) for r in B.assign_batches(df.repartition(9), ["k"], 64).collect())
    assert a == b


def test_seeded_shuffle_is_permutation_and_reproducible(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    a = {r.k: r.position for r in B.seeded_shuffle(df, "k", 3).collect()}
    b = {r.k: r.position for r in B.seeded_shuffle(df.repartition(5), "k", 3).collect()}
    assert a == b and sorted(a.values()) == list(range(1000))
    assert [k for k, _ in sorted(a.items(), key=lambda kv: kv[1])][:20] != list(range(20))


def test_assign_shards_round_robin(spark, tmp_dir):
    spark.range(0, 40).repartition(5).write.parquet(f"{tmp_dir}/d")
    df = spark.read.parquet(f"{tmp_dir}/d")
    out = B.assign_shards(df, 2).collect()
    files = sorted({r.file_path for r in out})
    for r in out:
        assert r.worker == files.index(r.file_path) % 2
