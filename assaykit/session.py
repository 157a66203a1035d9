"""Session helpers.

On a cluster the session comes from the launcher; these helpers only fill in
settings that are unset, so a cluster's own configuration always wins.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings this library relies on. Applied only where the session has no value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Where a tool puts a list, `stored` adds the plan of each table it writes.
STORED_PLANS: list[str] | None = None


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "assaykit") -> SparkSession:
    """Return the active session, or build one from the launcher's settings.

    What the launcher (spark-submit, PYSPARK_SUBMIT_ARGS, spark-defaults) has
    set is kept: a master, shuffle partitions or library setting is only given
    here where it is unset. An explicit argument wins. A session without any
    master is a local one.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        _apply_defaults(active)
        return active
    from pyspark import SparkConf, SparkContext

    SparkContext._ensure_initialized()  # starts the launcher's JVM, so its settings are readable
    given = SparkConf()
    builder = SparkSession.builder.appName(app_name)
    if master or not given.contains("spark.master"):
        builder = builder.master(master or os.environ.get("ASSAYKIT_MASTER", "local[8]"))
    settings = dict(_DEFAULTS)
    settings["spark.ui.enabled"] = "false"
    settings["spark.ui.showConsoleProgress"] = "false"
    settings["spark.driver.memory"] = os.environ.get("ASSAYKIT_DRIVER_MEMORY", "16g")
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    for key, value in settings.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _apply_defaults(spark: SparkSession) -> None:
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session. Where it is unset, a
    local master gets a scratch folder; any other master is an error, because
    executors cannot see each other's temporary folders.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current:
            sc.setCheckpointDir(current)
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="assaykit-ckpt-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; Spark's file system deletes it when the session ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/assaykit-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike an RDD checkpoint the copy is columnar, so later reads prune columns.
    """
    spark = df.sparkSession
    if STORED_PLANS is not None:
        STORED_PLANS.append(df._jdf.queryExecution().executedPlan().toString())
    path = shared_path(spark, name)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df):
    """Reliable checkpoint (lineage cut to the shared checkpoint folder), never a local one.

    Used before iterative consumers such as ML optimisers, which would
    otherwise re-run the whole upstream plan on every pass.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per Spark context).

    Workers unpickle functions by module name, so they need the package even
    when the driver was started from another folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_assaykit_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="assaykit-py-")
    clean = os.path.join(folder, "src", os.path.basename(package))
    shutil.copytree(package, clean, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "assaykit"), "zip", os.path.dirname(clean)))
    sc._assaykit_shipped = True
