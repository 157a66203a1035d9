"""The metric log: replayed batches, batches that fail half way, new checkpoints, files and loads."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from assaykit.streaming import metrics_log as L
from assaykit.streaming.metrics_stream import METRIC_SCHEMA

TS = dt.datetime(2024, 1, 1)


def put(spark, path, rows):
    spark.createDataFrame([(*r, TS) for r in rows], METRIC_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def steps(spark, log):
    return sorted((r.run_id, r.name, r.step) for r in L.read_log(spark, log).collect())


def batch(spark, src):
    return spark.read.schema(METRIC_SCHEMA).parquet(src).withColumn(L._FILE, F.col("_metadata.file_path"))


def test_a_replayed_batch_writes_nothing(spark, tmp_dir):
    src, log = f"{tmp_dir}/src", f"{tmp_dir}/log"
    put(spark, src, [(1, "loss", 0.5, 0), (2, "loss", float("nan"), 0), (None, "loss", 1.0, 3), (1, "loss", 0.5, 0)])
    assert L.read_log(spark, log).count() == 0
    assert L.load_once(batch(spark, src), log) == 3
    assert L.load_once(batch(spark, src), log) == 0
    put(spark, src, [(3, "mae", 2.0, 7)])
    assert L.load_once(batch(spark, src), log) == 1  # of two files only the new one
    got = sorted(((r.run_id is None, r.run_id), r.step) for r in L.read_log(spark, log).collect())
    assert got == [((False, 1), 0), ((False, 1), 0), ((False, 3), 7), ((True, None), 3)]


def test_a_batch_that_fails_half_way_is_not_read(spark, tmp_dir, monkeypatch):
    src, log = f"{tmp_dir}/src", f"{tmp_dir}/log"
    put(spark, src, [(1, "loss", 0.5, 0), (2, "loss", 0.25, 1)])

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(L, "_commit", dies)
        query = L.stream_to_log(spark, src, log, f"{tmp_dir}/check")
        with pytest.raises(Exception, match="gone"):
            query.awaitTermination()
    assert glob.glob(f"{log}/data/*/*.parquet") and L.read_log(spark, log).count() == 0
    L.stream_to_log(spark, src, log, f"{tmp_dir}/check").awaitTermination()  # Spark replays the batch
    assert steps(spark, log) == [(1, "loss", 0), (2, "loss", 1)]


def test_a_new_checkpoint_loads_no_file_again(spark, tmp_dir):
    src, log = f"{tmp_dir}/src", f"{tmp_dir}/log"
    for k in range(5):
        put(spark, src, [(k, "loss", float(k), s) for s in range(3)])
    L.stream_to_log(spark, src, log, f"{tmp_dir}/c0", max_files_per_trigger=2).awaitTermination()
    assert L.entries(spark, log).count() == 3
    put(spark, src, [(9, "loss", 1.0, 0)])
    L.stream_to_log(spark, src, log, f"{tmp_dir}/c1", max_files_per_trigger=2).awaitTermination()
    assert steps(spark, log) == sorted([(k, "loss", s) for k in range(5) for s in range(3)] + [(9, "loss", 0)])


def test_files_are_bounded_by_tasks_and_compacted(spark, tmp_dir):
    src, log = f"{tmp_dir}/src", f"{tmp_dir}/log"
    for k in range(3):
        put(spark, src, [(r, "loss", 1.0, k) for r in range(300)])
        L.load_once(batch(spark, src), log)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(len(glob.glob(f"{d}/*.parquet")) <= tasks for d in glob.glob(f"{log}/data/*"))
    before = steps(spark, log)
    load = L.compact(spark, log)
    assert glob.glob(f"{log}/data/*") == [f"{log}/data/{load}"] and steps(spark, log) == before and len(before) == 900
    assert L.compact(spark, log) is None
    assert L.load_once(batch(spark, src), log) == 0  # the compacted load knows its files
    put(spark, src, [(1, "loss", float("inf"), 9)])
    assert L.load_once(batch(spark, src), log) == 0 and L.entries(spark, log).count() == 2
    assert L.load_once(batch(spark, src), log) == 0 and L.entries(spark, log).count() == 2
