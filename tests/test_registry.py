"""Saved layers, versions and the marker; sparse features against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import graphs as G
from assaykit.operators import models as Mo
from assaykit.operators import registry as Rg


@pytest.fixture
def layers():
    rng = np.random.default_rng(1)
    return [(rng.normal(size=(3, 5)), rng.normal(size=5)), (rng.normal(size=(5, 2)), rng.normal(size=2))]


def test_layers_come_back_and_predict_alike(spark, layers, tmp_dir):
    Rg.save_layers(spark, layers, f"{tmp_dir}/m")
    back = Rg.load_layers(spark, f"{tmp_dir}/m")
    assert all(np.array_equal(a, b) for x, y in zip(layers, back) for a, b in zip(x, y)) and len(back) == 2
    rows = [(i, [float(i), i / 7, -1.0]) for i in range(5000)] + [(-1, None), (-2, [1.0]), (-3, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    for act in ("silu", "relu", "none"):
        a = {r.id: r.output for r in Rg.predict_layers(df, "v", back, act).collect()}
        b = {r.id: r.output for r in Mo.dense_forward(df, "v", layers, act).collect()}
        assert a[-1] is None and a[-2] is None and a[-3] is None and set(a) == set(b)
        assert all(a[i] == pytest.approx(b[i]) for i in range(5000))


def test_only_better_models_become_current(spark, layers, tmp_dir):
    root = f"{tmp_dir}/reg"
    assert Rg.current(spark, root) is None and Rg.described(spark, root).count() == 0 and Rg.prune(spark, root) == []
    assert Rg.publish_if_better(spark, root, layers, 0, 2.0) == 1
    assert Rg.publish_if_better(spark, root, layers, 1, 2.0) is None
    assert Rg.publish_if_better(spark, root, layers, 2, float("nan")) is None
    assert Rg.publish_if_better(spark, root, lambda: layers[1:], 3, 1.5) == 2
    assert tuple(Rg.described(spark, root).first()) == (2, 3, 1.5, 1, 5)
    assert tuple(Rg.described(spark, root, 1).first()) == (1, 0, 2.0, 2, 3)
    assert Rg.prune(spark, root) == [1] and Rg.versions(spark, root) == [2] and Rg.current(spark, root) == 2


def test_a_writer_that_dies_leaves_the_current_version(spark, layers, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/reg"
    Rg.publish(spark, root, layers, 0, 1.0)

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Rg, "_mark", dies)
        with pytest.raises(OSError, match="gone"):
            Rg.publish(spark, root, layers, 1, 0.5)
    assert Rg.current(spark, root) == 1 and Rg.versions(spark, root) == [1, 2]
    assert Rg.publish(spark, root, layers, 2, 0.25) == 3 and Rg.prune(spark, root) == [1, 2]
    assert Rg.described(spark, root).first().epoch == 2


def test_sparse_bits_equal_dense_ones(spark):
    rows = [(1, [0, 3, 9]), (2, []), (3, None), (4, [9, 9, 15, 16, -1])]
    df = spark.createDataFrame(rows, "id long, bits array<int>")
    got = {r.id: r.features for r in Mo.sparse_bits(df, "bits", 16).collect()}
    dense = {r.id: r.fingerprint for r in G.densify_bits(df.where("id <> 3"), "bits", 16).collect()}
    assert all(list(got[i].toArray()) == [float(x) for x in d] for i, d in dense.items())
    assert got[3].size == 16 and got[3].numNonzeros() == 0 and got[1].indices.tolist() == [0, 3, 9]


def test_ridge_matches_its_normal_equations(spark):
    rng = np.random.default_rng(3)
    bits = [sorted(set(rng.integers(0, 12, rng.integers(0, 8)).tolist())) for _ in range(400)]
    x = np.array([[1.0 if k in b else 0.0 for k in range(12)] for b in bits])
    y = x @ rng.normal(size=12) + 2 + rng.normal(size=400)
    df = spark.createDataFrame([(b, float(v)) for b, v in zip(bits, y)], "bits array<int>, pIC double")
    model = Mo.fit_baseline(Mo.sparse_bits(df, "bits", 12), regParam=0.1, standardization=False, solver="normal")
    one = np.column_stack([x, np.ones(400)])
    ridge = np.diag([0.1 / y.std() * 400] * 12 + [0.0])
    assert [*model.coefficients, model.intercept] == pytest.approx(np.linalg.solve(one.T @ one + ridge, one.T @ y), abs=1e-8)
    metrics = Mo.predict_table(Mo.sparse_bits(df, "bits", 12), model).agg(F.avg(F.abs(F.col("prediction") - F.col("pIC")))).first()[0]
    assert metrics < 1.2
