import math

import numpy as np
import pytest

from assaykit.operators import runs as R


def brute_early_stop(losses, patience=2, d=0.0):
    """Plain-Python fold of the stopping rule (NaN compares false both ways)."""
    best, best_ep, counter, trace = float("inf"), None, 0, []
    for e, l in enumerate(losses):
        imp = l is not None and not math.isnan(l) and l < best - d
        reg = l is not None and not math.isnan(l) and not imp and l > best + d
        if imp:
            best, best_ep, counter = l, e, 0
        elif reg:
            counter += 1
        trace.append((e, imp, best, best_ep, counter, counter >= patience))
        if counter >= patience:
            break
    return trace


CASES = [
    [5.0, 4.0, 4.5, 4.6, 3.0],            # stops at epoch 3
    [5.0, 5.0, 5.0, 5.0],                 # ties: never improves, never regresses
    [5.0, float("nan"), 6.0, 4.0, 4.1, 4.2, 4.3],
    [float("nan"), float("nan"), 1.0],
    [3.0, 2.0, 1.0, 0.5],                 # never stops
    [1.0],
]


def _frame(spark, cases):
    rows = [(r, e, l) for r, losses in enumerate(cases) for e, l in enumerate(losses)]
    return spark.createDataFrame(rows, "run_id long, epoch long, valid_loss double")


@pytest.mark.parametrize("d,method", [(0.0, "scan"), (0.0, "window"), (0.75, "scan")])
def test_early_stopping_matches_fold(spark, d, method):
    out = R.early_stopping(_frame(spark, CASES), patience=2, min_delta=d, method=method).collect()
    for r, losses in enumerate(CASES):
        got = sorted((x.epoch, x.improved, x.best_loss, x.best_epoch, x.counter, x.stop)
                     for x in out if x.run_id == r)
        assert got == brute_early_stop(losses, 2, d), (r, got)


def test_all_forms_agree_at_zero_delta(spark):
    rng = np.random.default_rng(0)
    cases = [[float(v) for v in rng.integers(0, 6, 12)] for _ in range(20)]
    df = _frame(spark, cases)
    a = sorted(tuple(r) for r in R.early_stopping(df, min_delta=0.0).collect())
    b = sorted(tuple(r) for r in R._early_stopping_steps(df, "run_id", "epoch", "valid_loss", 2, 0.0).collect())
    c = sorted(tuple(r) for r in R.early_stopping(df, min_delta=0.0, method="window").collect())
    assert a == b == c


@pytest.mark.parametrize("d", [0.3, 1.0, 2.5, 40.0])
def test_positive_delta_over_many_blocks(spark, d):
    """A run with most rows, losses that fall all along, in steps around delta, ties, NaN, nulls and infinities."""
    rng = np.random.default_rng(int(d * 10))
    slow = (np.arange(600, 0, -1) / 10).tolist()
    noisy = (100 - np.arange(400) / 10 + rng.integers(-3, 1, 400) / 4).tolist()
    odd = [float("inf"), None, float("nan"), 5.0, 5.0 - d, 5.0 - d - 1e-9, float("-inf"), 3.0, float("-inf"), 4.0]
    cases = [slow, noisy, odd, [1.0], [float("nan")], [None, 2.0], *[(rng.integers(0, 40, 30) / 4).tolist() for _ in range(8)]]
    for patience in (2, 10 ** 6):
        out = R.early_stopping(_frame(spark, cases).repartition(5), patience=patience, min_delta=d).collect()
        for r, losses in enumerate(cases):
            got = sorted((x.epoch, x.improved, x.best_loss, x.best_epoch, x.counter, x.stop) for x in out if x.run_id == r)
            assert got == brute_early_stop(losses, patience, d), (r, patience)


def test_a_run_is_spread_over_tasks_at_positive_delta(spark):
    """All losses of one run: only its strict minima within delta of a block's start reach one task."""
    rows = [("only", e, 1000.0 - e) for e in range(4000)] + [(None, e, float(e)) for e in range(5)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, valid_loss double")
    out = R.early_stopping(df, patience=2, min_delta=2.5)
    assert out.schema["epoch"].dataType.simpleString() == "int"
    got = out.collect()
    assert sum(r.improved for r in got if r.run_id) == 1334 and sum(1 for r in got if r.run_id is None) == 5
    assert {r.best_epoch for r in got if r.run_id and r.epoch == 3999} == {3999}
    with pytest.raises(ValueError, match="negative"):
        R.early_stopping(df, min_delta=-1.0)


def test_best_epoch(spark):
    trace = R.early_stopping(_frame(spark, CASES))
    got = {r.run_id: r for r in R.best_epoch(trace).collect()}
    assert got[0].best_epoch == 1 and got[0].best_loss == 4.0 and got[0].stopped_early
    assert got[4].best_epoch == 3 and not got[4].stopped_early
    assert got[3].best_epoch == 2


def test_run_params_pivot(spark):
    df = spark.createDataFrame([(1, "lr", "0.1"), (1, "bs", "256"), (2, "lr", "0.2")], "run_id long, key string, value string")
    got = {r.run_id: r for r in R.run_params(df, ["lr", "bs"]).collect()}
    assert got[1].lr == "0.1" and got[1].bs == "256" and got[2].bs is None


@pytest.mark.parametrize("n,size,drop,expect", [(10, 5, True, 2), (11, 5, True, 2), (11, 5, False, 3), (3, 5, True, 0)])
def test_batch_count(spark, n, size, drop, expect):
    assert R.batch_count(spark.range(n), size, drop).collect()[0].n_batches == expect
