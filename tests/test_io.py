import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from assaykit.plans.training import write_splits
from assaykit.sources import io
from assaykit.sources.tables import read_table


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_export_dataset_formats(spark, tmp_dir, fmt):
    df = spark.range(0, 250).select(F.col("id").alias("a"), (F.col("id") * 0.5).alias("b"))
    schema = StructType([StructField("b", DoubleType()), StructField("a", LongType())])
    path = io.export_dataset(df, "t", tmp_dir, fmt=fmt, schema=schema, max_records_per_file=100)
    back = io.read_source(spark, fmt, path, schema=schema)
    assert back.count() == 250 and back.columns == ["b", "a"]
    assert len([f for f in os.listdir(path) if not f.startswith((".", "_"))]) >= 3
    with pytest.raises(Exception):
        io.export_dataset(df, "t", tmp_dir, fmt=fmt)  # errorifexists by default


def test_export_rejects_unknown_format(spark, tmp_dir):
    with pytest.raises(ValueError):
        io.export_dataset(spark.range(1), "x", tmp_dir, fmt="xls")


def test_jdbc_options():
    o = io.jdbc_options("jdbc:sqlite:/x.db", query="SELECT * FROM a", partition_column="id",
                        lower_bound=0, upper_bound=100, num_partitions=4)
    assert o["dbtable"] == "(SELECT * FROM a) AS src" and o["numPartitions"] == "4" and o["fetchsize"] == "100000"
    assert "query" not in o
    assert io.jdbc_options("jdbc:x", table="t")["dbtable"] == "t"
    with pytest.raises(ValueError):
        io.jdbc_options("jdbc:x")
    with pytest.raises(ValueError):
        io.jdbc_options("jdbc:x", table="t", partition_column="id")


def test_read_table_requires_parquet(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/empty")
    with pytest.raises(FileNotFoundError):
        read_table(spark, tmp_dir, "empty")
    spark.range(3).write.parquet(f"{tmp_dir}/ok")
    assert read_table(spark, tmp_dir, "ok").count() == 3


def test_append_metrics_keeps_finite(spark, tmp_dir):
    df = spark.createDataFrame([(1, "loss", 1.0, 0), (1, "loss", float("nan"), 1), (2, "loss", float("inf"), 0)],
                               "run_id long, name string, value double, step long")
    io.append_metrics(df, f"{tmp_dir}/m")
    io.append_metrics(df, f"{tmp_dir}/m")
    back = spark.read.parquet(f"{tmp_dir}/m")
    assert back.count() == 2 and {r.run_id for r in back.collect()} == {1}


def test_write_splits_layouts(spark, tmp_dir):
    df = spark.range(0, 50).select(F.col("id"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"))
    write_splits(df, f"{tmp_dir}/p")
    assert spark.read.parquet(f"{tmp_dir}/p").where("split = 'val'").count() == 10
    write_splits(df, f"{tmp_dir}/s", layout="separate")
    assert spark.read.parquet(f"{tmp_dir}/s_train").count() == 40


def test_stored_cuts_lineage(spark):
    from assaykit.session import stored

    m = stored(spark.range(0, 10).withColumn("x", F.col("id") * 2), "unit")
    assert sorted(r.x for r in m.collect()) == list(range(0, 20, 2))
    assert "Range" not in m._jdf.queryExecution().optimizedPlan().toString()


def test_read_table_fails_without_parquet(spark, tmp_dir):
    import os

    from assaykit.sources.tables import read_table

    os.makedirs(f"{tmp_dir}/empty")
    for base in (tmp_dir, f"file://{tmp_dir}"):
        with pytest.raises(FileNotFoundError):
            read_table(spark, base, "empty")
        with pytest.raises(FileNotFoundError):
            read_table(spark, base, "nothing")
    spark.range(3).write.parquet(f"{tmp_dir}/full")
    assert read_table(spark, f"file://{tmp_dir}", "full").count() == 3


def test_checkpoint_dir_is_the_sessions(spark):
    from assaykit.session import checkpoint_dir, shared_path

    given = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    assert checkpoint_dir(spark) == (given or spark.sparkContext.getCheckpointDir())
    assert shared_path(spark, "x").startswith(checkpoint_dir(spark).rstrip("/"))
