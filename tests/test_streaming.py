import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from assaykit.sources import io
from assaykit.streaming.metrics_stream import METRIC_SCHEMA, stream_metrics


def _batch(spark, path, rows):
    spark.createDataFrame(rows, METRIC_SCHEMA).write.mode("append").parquet(path)


def test_stream_metrics_available_now_and_restart(spark, tmp_dir):
    src, dst, ck = f"{tmp_dir}/src", f"{tmp_dir}/dst", f"{tmp_dir}/ck"
    ts = dt.datetime(2024, 1, 1)
    _batch(spark, src, [(1, "loss", 0.5, 0, ts), (1, "loss", float("nan"), 1, ts), (2, "mae", 1.0, 0, ts)])
    q = stream_metrics(spark, src, dst, ck)
    q.awaitTermination()
    assert spark.read.parquet(dst).count() == 2
    # new file arrives; the restarted query only processes the new data (checkpointed offsets)
    _batch(spark, src, [(1, "loss", 0.4, 2, ts), (3, "loss", float("inf"), 0, ts)])
    q = stream_metrics(spark, src, dst, ck)
    q.awaitTermination()
    out = spark.read.parquet(dst)
    assert out.count() == 3
    assert sorted(r.step for r in out.where("run_id = 1").collect()) == [0, 2]


@pytest.mark.parametrize("parts", [io.RUN_PARTS, 5])
def test_folders_do_not_grow_with_the_runs(spark, tmp_dir, parts):
    """900 runs and rows without one: few folders, files and micro-batches, every finite row once, one run in one folder."""
    ts = dt.datetime(2024, 1, 1)
    rows = [(r or None, "loss", float("nan") if s == 2 else r / 8, s, ts) for r in range(901) for s in range(3)]
    src, dst = f"{tmp_dir}/src", f"{tmp_dir}/dst"
    io.append_metrics(spark.createDataFrame(rows, METRIC_SCHEMA), src, parts=parts)
    stream_metrics(spark, src, dst, f"{tmp_dir}/ck", parts=parts).awaitTermination()
    for path in (src, dst):
        assert 1 < len(glob.glob(f"{path}/*=*")) <= parts
        assert len(glob.glob(f"{path}/*=*/*.parquet")) <= 2 * parts
    assert len(glob.glob(f"{tmp_dir}/ck/commits/*")) <= 3
    out = spark.read.schema(METRIC_SCHEMA).parquet(dst)
    key = lambda r: (r[0] or 0, r[3])
    assert sorted((tuple(r)[:5] for r in out.collect()), key=key) == sorted((r for r in rows if r[3] < 2), key=key)
    one = out.where(F.col(io.RUN_PART) == io.run_part(F.lit(7), parts))
    assert one.where("run_id = 7").count() == 2 and one.select(F.col("_metadata.file_path")).distinct().count() <= 2


def test_a_folder_a_run_where_asked_for(spark, tmp_dir):
    src, dst = f"{tmp_dir}/src", f"{tmp_dir}/dst"
    ts = dt.datetime(2024, 1, 1)
    rows = [(1, "loss", 0.5, 0, ts), (2, "loss", 0.25, 0, ts), (1, "loss", float("inf"), 1, ts)]
    io.append_metrics(spark.createDataFrame(rows, METRIC_SCHEMA), src, parts=None)
    stream_metrics(spark, src, dst, f"{tmp_dir}/ck", parts=None).awaitTermination()
    for path in (src, dst):
        assert sorted(p.rsplit("/", 1)[1] for p in glob.glob(f"{path}/*=*")) == ["run_id=1", "run_id=2"]
    assert spark.read.parquet(dst).count() == 2
