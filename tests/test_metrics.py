import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import metrics as M


def _r2(y, p):
    y, p = np.asarray(y, float), np.asarray(p, float)
    n = len(y)
    if n <= 1:
        return float("nan")
    sse = float(((p - y) ** 2).sum())
    sst = float((y ** 2).sum() - y.sum() ** 2 / n)
    if sst <= 0:
        return 1.0 if sse <= 1e-12 else 0.0
    return 1 - sse / sst


def test_r2_edges(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 2.0),  # one-row group
                                (1, 0, 3.0, 3.0), (1, 1, 3.0, 3.0),  # constant truth, exact
                                (2, 0, 3.0, 4.0), (2, 1, 3.0, 3.0),  # constant truth, errors
                                (3, 0, 1.0, 1.5), (3, 1, 2.0, 2.0), (3, 2, 4.0, 3.0)],
                               "g long, i long, truth double, pred double")
    got = {r.g: r.r2 for r in M.metrics_from_sums(M.regression_sums(df, by=["g"])).collect()}
    assert math.isnan(got[0])
    assert got[1] == 1.0 and got[2] == 0.0
    assert got[3] == pytest.approx(_r2([1, 2, 4], [1.5, 2, 3]))


def test_huber_and_losses(spark):
    df = spark.createDataFrame([(0.0, 0.2), (0.0, -2.0), (1.0, 1.5)], "truth double, pred double")
    rows = M.row_losses(df, delta=0.5).collect()
    assert rows[0].huber == pytest.approx(0.5 * 0.2 ** 2)
    assert rows[1].huber == pytest.approx(0.5 * (2.0 - 0.25))
    assert rows[2].huber == pytest.approx(0.5 * 0.5 ** 2)
    assert rows[1].squared_error == pytest.approx(4.0)


def test_rollup_levels_merge_exactly(spark):
    rng = np.random.default_rng(3)
    data = [(int(e), int(b), float(t), float(t + rng.normal(0, 0.3)))
            for e in range(3) for b in range(5) for t in rng.normal(5, 1, 7)]
    df = spark.createDataFrame(data, "epoch int, batch_id long, truth double, pred double")
    m = M.regression_metrics(df)
    rows = m.collect()
    total = [r for r in rows if r.level == 0][0]
    assert total.n == len(data)
    y = np.array([d[2] for d in data]); p = np.array([d[3] for d in data])
    assert total.rmse == pytest.approx(float(np.sqrt(((p - y) ** 2).mean())))
    assert total.r2 == pytest.approx(_r2(y, p))
    # epoch loss equals the batch-size weighted mean of batch losses
    for e in range(3):
        ep = [r for r in rows if r.level == 1 and r.epoch == e][0]
        bs = [r for r in rows if r.level == 2 and r.epoch == e]
        assert ep.loss == pytest.approx(sum(b.loss * b.n for b in bs) / sum(b.n for b in bs))
        assert ep.n == sum(b.n for b in bs)


def test_tensor_stats(spark):
    df = spark.createDataFrame([("a", [0.0, 1.0, 2.0]), ("a", [0.0, 3.0]), ("b", [5.0])], "name string, values array<double>")
    got = {r.name: r for r in M.tensor_stats(df).collect()}
    vals = np.array([0, 1, 2, 0, 3], float)
    assert got["a"].std == pytest.approx(vals.std()) and got["a"].var == pytest.approx(vals.var())
    assert got["a"].zero_fraction == pytest.approx(0.4)
    assert got["b"].std == 0.0
