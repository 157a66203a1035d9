"""Model jobs on Spark ML.

The reference trains single-machine networks. Here the same roles are
filled by distributed Spark ML estimators: a linear baseline on fingerprint
vectors, a Huber-loss regressor tuned on a validation split, table-wide
prediction, and saving the best model with its metadata. A fixed stack of
dense layers (weights given by the caller) is applied batch-wise with an
Arrow pandas UDF.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from assaykit.operators.splits import in_sample

HUBER_EPSILON = 1.35
# Where the loss that chooses the model turns from squared to linear.
HUBER_DELTA = 0.5


def to_vector(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Numeric array column -> ML dense vector."""
    return df.withColumn(out or col, array_to_vector(F.transform(col, lambda x: x.cast("double"))))


def sparse_bits(df: DataFrame, bits: str = "bits", n_bits: int = 2048, out: str = "features") -> DataFrame:
    """List of set bits -> ML sparse vector of width ``n_bits`` (M1), without the dense 0/1 array.

    Bits outside the width are left out; a NULL list is the empty vector.
    """
    names = CountVectorizerModel.from_vocabulary([str(i) for i in range(n_bits)], "_names", out)
    names.setBinary(True)
    named = F.coalesce(F.transform(bits, lambda b: b.cast("string")), F.array().cast("array<string>"))
    return names.transform(df.withColumn("_names", named)).drop("_names")


def fit_baseline(train: DataFrame, features: str = "features", label: str = "pIC",
                 kind: str = "linear", **params) -> Model:
    """Baseline regressor on fingerprint vectors (M1): ``linear`` or ``gbt``."""
    if kind == "linear":
        est = LinearRegression(featuresCol=features, labelCol=label, **params)
    elif kind == "gbt":
        est = GBTRegressor(featuresCol=features, labelCol=label, **params)
    else:
        raise ValueError(f"kind must be 'linear' or 'gbt', got {kind!r}")
    return est.fit(train)


def fit_robust(train: DataFrame, features: str = "features", label: str = "pIC",
               reg_params: Sequence[float] = (0.0, 0.01, 0.1), valid: Column | None = None,
               key: str | None = None, delta: float = HUBER_DELTA, epsilon: float = HUBER_EPSILON) -> Model:
    """Huber-loss linear regression, regularisation chosen by Huber loss on a validation split (M2).

    ``valid`` marks the validation rows; without it they are a fifth of the
    rows by the hash of ``key`` (or of the features and the label), which
    doesn't depend on the partitions.

    Spark's ``epsilon`` is relative to a fitted scale and must exceed 1, so
    it is not the reference's absolute delta of 0.5.
    """
    if valid is None:
        by = F.col(key).cast("string") if key else F.concat_ws("|", F.col(features).cast("string"), F.col(label))
        valid = in_sample(by, 0.2, 42)
    rows = train.withColumn("_valid", valid)
    fitted = rows.where(~F.col("_valid"))
    best: tuple[float, Model] | None = None
    for reg in reg_params:
        model = LinearRegression(featuresCol=features, labelCol=label, loss="huber", epsilon=epsilon,
                                 regParam=reg).fit(fitted)
        off = F.abs(F.col("prediction") - F.col(label))
        huber = F.when(off <= delta, 0.5 * off * off).otherwise(delta * (off - 0.5 * delta))
        loss = model.transform(rows.where(F.col("_valid"))).agg(F.avg(huber)).first()[0]
        if best is None or (loss is not None and loss < best[0]):
            best = (float("inf") if loss is None else loss, model)
    return best[1]


def predict_table(df: DataFrame, model: Model) -> DataFrame:
    """Score a whole table with a fitted model (M3)."""
    return model.transform(df)


def save_best(model: Model, path: str, metadata: Mapping[str, object]) -> None:
    """Save the model and a one-row metadata table next to it (M4)."""
    model.write().overwrite().save(path)
    spark = model_spark()
    row = {k: (float(v) if isinstance(v, float) else v) for k, v in metadata.items()}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").parquet(f"{path}_meta")


def model_spark():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def fold_batch_norm(weights: np.ndarray, bias: np.ndarray, gamma: np.ndarray, beta: np.ndarray, mean: np.ndarray,
                    variance: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """One (W, b) for a dense layer and the batch normalisation behind it, at inference.

    (x W + b - mean) / sqrt(variance + eps) * gamma + beta is again a dense layer.
    """
    scale = np.asarray(gamma, dtype=np.float64) / np.sqrt(np.asarray(variance, dtype=np.float64) + eps)
    return np.asarray(weights) * scale, (np.asarray(bias) - np.asarray(mean)) * scale + np.asarray(beta)


def apply_layers(x: np.ndarray, layers: Sequence[tuple[np.ndarray, np.ndarray]], activation: str) -> np.ndarray:
    """Dense layers on the rows of a matrix; the activation ('silu', 'relu' or another name for none) between them."""
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            if activation == "silu":
                x = x / (1.0 + np.exp(-x))
            elif activation == "relu":
                x = np.maximum(x, 0.0)
    return x


def dense_forward(df: DataFrame, col: str, layers: Sequence[tuple[np.ndarray, np.ndarray]],
                  activation: str = "silu", out: str = "output") -> DataFrame:
    """Apply dense layers x -> act(x W + b) ... to an array column, batch-wise.

    The weights are fixed-size model parameters captured by the UDF closure;
    each Arrow batch becomes one matrix product per layer. No activation
    after the last layer. A NULL array, one of another width or one that
    holds a NULL has a NULL output. ``fold_batch_norm`` puts a normalisation
    layer into the weights before it.
    """
    mats = [(np.asarray(w, dtype=np.float64), np.asarray(b, dtype=np.float64)) for w, b in layers]
    width = mats[0][0].shape[0]

    @F.pandas_udf(ArrayType(DoubleType()))
    def forward(v: pd.Series) -> pd.Series:
        good = [a is not None and len(a) == width and not any(e is None for e in a) for a in v]
        result: list = [None] * len(v)
        if any(good):
            x = apply_layers(np.stack([np.asarray(a, dtype=np.float64) for a, g in zip(v, good) if g]), mats, activation)
            for i, row in zip(np.flatnonzero(good), x):
                result[i] = row
        return pd.Series(result, dtype=object)

    return df.withColumn(out, forward(F.col(col)))
