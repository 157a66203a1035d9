"""Saved models: layer weights as tables, versions with one current marker, prediction in batches (M3, M4).

A registry is a folder with one folder per version and a marker file that
names the current one. A version is written completely before the marker is
replaced by a rename, which is atomic, so a reader sees the old version or the
new one and never a part; a version whose writer died is never current and
goes with the next pruning. All paths are on the file system that Spark's
executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from assaykit.operators.models import apply_layers
from assaykit.session import ship_package

Layers = Sequence[tuple[np.ndarray, np.ndarray]]
MARKER = "CURRENT"
_LAYERS = "layer int, place int, weights array<double>"
_META = "version long, epoch long, loss double, n_layers int, width int"
#: Rows of one call of the model.
BATCH = 4096


def save_layers(spark: SparkSession, layers: Layers, path: str) -> None:
    """One row per input of each layer and one, the last, for its bias."""
    rows = []
    for i, (w, b) in enumerate(layers):
        rows += [(i, k, [float(x) for x in r]) for k, r in enumerate(np.vstack([w, b]))]
    spark.createDataFrame(rows, _LAYERS).coalesce(1).write.parquet(path)


def load_layers(spark: SparkSession, path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers as they were saved. Weights come to the driver: they are a model, whose size doesn't grow with data."""
    found: dict[int, dict[int, list[float]]] = {}
    for r in spark.read.schema(_LAYERS).parquet(path).collect():
        found.setdefault(r.layer, {})[r.place] = r.weights
    stacked = [np.array([found[i][k] for k in sorted(found[i])]) for i in sorted(found)]
    return [(m[:-1], m[-1]) for m in stacked]


def predict_layers(df: DataFrame, col: str, layers: Layers, activation: str = "silu", out: str = "output") -> DataFrame:
    """Apply the layers to an array column; the model is set up once per Python worker and called on batches of rows.

    A NULL array, one of another width or one that holds a NULL has a NULL output.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float)) for w, b in layers])
    width = int(np.asarray(layers[0][0]).shape[0])

    def make():
        mats = shared.value

        def predict(x: np.ndarray) -> np.ndarray:
            return apply_layers(x, mats, activation)

        return predict

    run = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=BATCH, input_tensor_shapes=[[width]])
    x = F.transform(F.col(col), lambda v: v.cast("double"))
    good = F.coalesce((F.size(col) == width) & ~F.exists(col, lambda v: v.isNull()), F.lit(False))
    filled = df.withColumn("_x", F.when(good, x).otherwise(F.array_repeat(F.lit(0.0), width))).withColumn("_good", good)
    return filled.withColumn(out, F.when(F.col("_good"), run("_x"))).drop("_x", "_good")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all version folders, complete or not."""
    fs, jroot = _fs(spark, root)
    if not fs.exists(jroot):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jroot)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def current(spark: SparkSession, root: str) -> int | None:
    """The version the marker names, or None."""
    fs, marker = _fs(spark, f"{root}/{MARKER}")
    if not fs.exists(marker):
        return None
    return int(spark.read.text(f"{root}/{MARKER}").first()[0])


def model_path(root: str, version: int) -> str:
    return f"{root}/v{version}/model"


def _mark(spark: SparkSession, root: str, version: int) -> None:
    fs, draft = _fs(spark, f"{root}/{MARKER}.v{version}")
    stream = fs.create(draft, True)
    stream.write(bytearray(str(version).encode()))
    stream.close()
    jvm = spark._jvm
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{MARKER}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(target), rename)


def publish(spark: SparkSession, root: str, layers: Layers, epoch: int, loss: float) -> int:
    """Write a new version and make it the current one; returns its number."""
    version = max(versions(spark, root), default=0) + 1
    save_layers(spark, layers, model_path(root, version))
    meta = [(version, int(epoch), float(loss), len(layers), int(np.asarray(layers[0][0]).shape[0]))]
    spark.createDataFrame(meta, _META).coalesce(1).write.parquet(f"{root}/v{version}/meta")
    _mark(spark, root, version)
    return version


def described(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """One row: version, epoch, loss, n_layers, width of a version (the current one); none if there is none."""
    version = current(spark, root) if version is None else version
    if version is None:
        return spark.createDataFrame([], _META)
    return spark.read.schema(_META).parquet(f"{root}/v{version}/meta")


def publish_if_better(spark: SparkSession, root: str, layers: Callable[[], Layers] | Layers, epoch: int, loss: float) -> int | None:
    """Publish only a strictly lower loss than the current version's; the number, or None where the current one stays."""
    now = described(spark, root).first()
    if loss != loss or (now is not None and not loss < now.loss):
        return None
    return publish(spark, root, layers() if callable(layers) else layers, epoch, loss)


def prune(spark: SparkSession, root: str) -> list[int]:
    """Delete all versions but the current one; returns what went. Nothing goes where no version is current."""
    kept = current(spark, root)
    gone = [v for v in versions(spark, root) if v != kept] if kept is not None else []
    for v in gone:
        fs, path = _fs(spark, f"{root}/v{v}")
        fs.delete(path, True)
    return gone
