import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import models as Mo


@pytest.fixture
def linear_data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + 3.0
    rows = [(i, [float(v) for v in x[i]], float(y[i]), "val" if i % 5 == 0 else "train") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, arr array<double>, pIC double, split string")
    return Mo.to_vector(df, "arr", "features")


def test_fit_baseline_and_predict(linear_data):
    model = Mo.fit_baseline(linear_data.where("split = 'train'"))
    pred = Mo.predict_table(linear_data.where("split = 'val'"), model)
    err = pred.select(F.max(F.abs(F.col("prediction") - F.col("pIC")))).collect()[0][0]
    assert err < 1e-6


def test_fit_robust(linear_data):
    model = Mo.fit_robust(linear_data.where("split = 'train'"), reg_params=(0.0, 0.1))
    pred = Mo.predict_table(linear_data.where("split = 'val'"), model)
    assert pred.select(F.avg(F.abs(F.col("prediction") - F.col("pIC")))).collect()[0][0] < 0.05


def test_gbt_kind_and_bad_kind(linear_data):
    m = Mo.fit_baseline(linear_data, kind="gbt", maxIter=3, maxDepth=2)
    assert Mo.predict_table(linear_data, m).count() == 300
    with pytest.raises(ValueError):
        Mo.fit_baseline(linear_data, kind="mlp")


def test_save_best_roundtrip(spark, linear_data, tmp_dir):
    from pyspark.ml.regression import LinearRegressionModel

    model = Mo.fit_baseline(linear_data)
    Mo.save_best(model, f"{tmp_dir}/best", {"epoch": 3, "valid_loss": 0.25})
    back = LinearRegressionModel.load(f"{tmp_dir}/best")
    assert np.allclose(back.coefficients.toArray(), model.coefficients.toArray())
    meta = spark.read.parquet(f"{tmp_dir}/best_meta").collect()[0]
    assert meta.epoch == 3 and meta.valid_loss == 0.25


def test_dense_forward_matches_numpy(spark):
    rng = np.random.default_rng(1)
    layers = [(rng.normal(size=(3, 5)), rng.normal(size=5)), (rng.normal(size=(5, 2)), rng.normal(size=2))]
    x = rng.normal(size=(20, 3))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(20)], "id long, v array<double>")
    got = {r.id: r.output for r in Mo.dense_forward(df, "v", layers, "silu").collect()}
    h = x @ layers[0][0] + layers[0][1]
    h = h / (1 + np.exp(-h))
    exp = h @ layers[1][0] + layers[1][1]
    for i in range(20):
        assert got[i] == pytest.approx(list(exp[i]))
