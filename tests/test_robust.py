"""Reweighted least squares against the same steps in NumPy and against the minimum itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import robust as R


def plain(x, y, delta, reg, steps):
    x = np.column_stack([x, np.ones(len(y))])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([reg * len(y)] * (x.shape[1] - 1) + [0.0])
    for k in range(steps):
        e = np.abs(y - x @ beta)
        w = np.where(e <= delta, 1.0, delta / np.maximum(e, 1e-300)) if k else np.ones(len(y))
        beta = np.linalg.solve((x * w[:, None]).T @ x + ridge, (x * w[:, None]).T @ y)
    return beta


def loss(x, y, beta, delta):
    e = np.abs(y - x @ beta[:-1] - beta[-1])
    return np.where(e <= delta, 0.5 * e * e, delta * (e - 0.5 * delta)).mean()


@pytest.fixture(scope="module")
def noisy(spark):
    """A plane with a fifth of the labels far off, and rows that take no part."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 3.0 + rng.normal(0, 0.1, 400)
    y[::5] += rng.uniform(5, 40, 80)
    rows = [(i, [float(v) for v in x[i]], float(y[i]), i % 4 == 0) for i in range(400)]
    odd = [(1000, None, 1.0, False), (1001, [1.0, 2.0], 1.0, False), (1002, [1.0, None, 2.0], 1.0, True),
           (1003, [1.0, float("nan"), 2.0], 1.0, False), (1004, [1.0, 2.0, 3.0], None, False), (1005, [1.0, 2.0, 3.0], float("nan"), True)]
    return spark.createDataFrame(rows + odd, "id long, features array<double>, pIC double, held boolean").repartition(7), x, y


@pytest.mark.parametrize("delta, reg", [(0.5, 0.0), (0.5, 0.1), (2.0, 0.01)])
def test_steps_match_numpy(noisy, delta, reg):
    df, x, y = noisy
    model = R.fit_huber(df, valid=F.col("held"), delta=delta, reg_params=[reg], steps=6)
    held = np.arange(400) % 4 == 0
    assert model.coefficients == pytest.approx(plain(x[~held], y[~held], delta, reg, 6), abs=1e-9)
    assert model.trace[-1][2:] == pytest.approx((loss(x[~held], y[~held], np.array(model.coefficients), delta),
                                                 loss(x[held], y[held], np.array(model.coefficients), delta)))


def test_outliers_do_not_move_the_plane(noisy):
    df, x, y = noisy
    model = R.fit_huber(df, valid=F.col("held"), reg_params=[0.0], steps=30)
    assert model.coefficients == pytest.approx([1.0, -2.0, 0.5, 3.0], abs=0.2)
    losses = [t[2] for t in model.trace]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))  # every step lowers the loss
    for i in range(4):  # no neighbour is better: the minimum for the absolute delta
        for d in (-1e-2, 1e-2):
            near = np.array(model.coefficients)
            near[i] += d
            held = np.arange(400) % 4 == 0
            assert loss(x[~held], y[~held], near, 0.5) > losses[-1]


def test_least_validation_loss_chooses(noisy):
    df, _, _ = noisy
    model = R.fit_huber(df, valid=F.col("held"), reg_params=[100.0, 0.001], steps=4)
    assert model.reg == 0.001 and set(model.path) == {100.0, 0.001} and len(model.trace) == 8
    none = R.fit_huber(df, valid=F.lit(None).cast("boolean"), reg_params=[100.0, 0.001], steps=4)
    assert none.reg == 100.0 and none.trace[-1][3] is None


def test_predict_and_constant_feature(spark, noisy):
    df, _, _ = noisy
    model = R.fit_huber(df.withColumn("features", F.concat("features", F.array(F.lit(0.0)))), valid=F.col("held"), reg_params=[0.0])
    got = {r.id: r.p for r in df.select("id", model.predict(F.concat("features", F.array(F.lit(0.0)))).alias("p")).collect()}
    assert got[1000] is None and got[1001] is None and got[1002] is None
    features = {r.id: r.features for r in df.where("id < 10").collect()}
    assert all(got[i] == pytest.approx(np.dot([*f, 0.0, 1.0], model.coefficients)) for i, f in features.items())


def test_errors(spark):
    empty = spark.createDataFrame([], "features array<double>, pIC double")
    with pytest.raises(ValueError, match="no rows"):
        R.fit_huber(empty, valid=F.lit(False))
    wide = spark.range(1).select(F.array_repeat(F.lit(1.0), R.MOST_FEATURES + 1).alias("features"), F.lit(1.0).alias("pIC"))
    with pytest.raises(ValueError, match="at most"):
        R.fit_huber(wide, valid=F.lit(False))
