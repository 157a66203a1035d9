"""Robust linear regression with an absolute Huber delta (M2), by reweighted least squares.

The loss of a row is e² / 2 up to |e| = delta and delta (|e| - delta / 2)
beyond. Its minimum is that of least squares in which a row beyond delta
weighs delta / |e|, so each step is one aggregate over the rows: X'WX and X'Wy
of the weights that the last coefficients give, added up per task and then
over all tasks. Only these sums, (width + 1)² numbers a regularisation, reach
the driver, which solves for the next coefficients. All regularisations share
the pass over the rows, and so do the losses on training and validation rows.
The number of steps is fixed.

Rows whose label or features are missing, NaN, or of another width take no
part; their prediction is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.session import ship_package

HUBER_DELTA = 0.5
STEPS = 8
REG_PARAMS = (0.001, 0.01, 0.1)
#: Widths beyond this make the normal equations too large for the driver (8 MB a regularisation).
MOST_FEATURES = 1000


@dataclass(frozen=True)
class HuberModel:
    """Coefficients with the intercept last; ``trace`` has (reg, step, train_loss, valid_loss), ``path`` all fits."""

    coefficients: tuple[float, ...]
    reg: float
    delta: float
    trace: tuple[tuple[float, int, float | None, float | None], ...]
    path: dict[float, tuple[float, ...]]

    def predict(self, features: str | Column) -> Column:
        """The prediction as a column expression."""
        x = F.col(features) if isinstance(features, str) else features
        *slopes, intercept = self.coefficients
        products = F.zip_with(x, F.lit(list(slopes)), lambda a, b: a.cast("double") * b)
        total = F.aggregate(products, F.lit(intercept), lambda a, b: a + b)
        return F.when(F.size(x) == len(slopes), total)


def usable(features: Column, label: Column, width: int) -> Column:
    """Rows that take part: ``width`` features and a label, none of them missing or NaN."""
    bad = F.exists(features, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return (F.size(features) == width) & ~bad & label.isNotNull() & ~F.isnan(label.cast("double"))


def _partial(x: np.ndarray, y: np.ndarray, valid: np.ndarray, beta: np.ndarray, delta: float, start: bool) -> np.ndarray:
    """[X'WX and X'Wy as rows, train rows, their loss, validation rows, their loss] of one batch."""
    off = y - x @ beta
    size = np.abs(off)
    loss = np.where(size <= delta, 0.5 * off * off, delta * (size - 0.5 * delta))
    weight = np.ones(len(y)) if start else delta / np.maximum(size, delta)
    train = ~valid
    wx = x[train] * weight[train, None]
    both = np.column_stack([wx.T @ x[train], wx.T @ y[train]])
    return np.concatenate([both.ravel(), [train.sum(), loss[train].sum(), valid.sum(), loss[valid].sum()]])


def step_sums(rows: DataFrame, betas: Sequence[np.ndarray], delta: float, start: bool) -> list[np.ndarray]:
    """One pass: the sums of ``_partial`` for each of the coefficient vectors, over ``rows`` (x, y, valid)."""
    ship_package(rows.sparkSession)
    width = len(betas[0])
    length = width * (width + 1) + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(betas), length))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width - 1)
                x = np.column_stack([x, np.ones(b.num_rows)])
                y, valid = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                totals += [_partial(x, y, valid, beta, delta, start) for beta in betas]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(betas)), pa.int32()), pa.array(totals.tolist(), pa.list_(pa.float64()))], names=["fit", "sums"])

    parts = rows.mapInArrow(run, "fit int, sums array<double>")
    added = parts.select("fit", F.posexplode("sums").alias("i", "v")).groupBy("fit", "i").agg(F.sum("v").alias("v"))
    out = [np.zeros(length) for _ in betas]
    for r in added.collect():
        out[r.fit][r.i] = r.v
    return out


def _solve(sums: np.ndarray, width: int, reg: float) -> np.ndarray:
    both = sums[:width * (width + 1)].reshape(width, width + 1)
    ridge = np.diag([reg * sums[-4]] * (width - 1) + [0.0])  # the intercept is free
    return np.linalg.lstsq(both[:, :-1] + ridge, both[:, -1], rcond=None)[0]


def fit_huber(rows: DataFrame, features: str = "features", label: str = "pIC", *, valid: Column, delta: float = HUBER_DELTA,
              reg_params: Sequence[float] = REG_PARAMS, steps: int = STEPS) -> HuberModel:
    """Coefficients for each regularisation; the model is the one with the least loss on the ``valid`` rows.

    The objective is the mean loss plus reg / 2 times the squared slopes.
    ``rows`` are read ``steps + 2`` times: give a stored table. Ties, and no
    validation rows, choose the first regularisation.
    """
    width = rows.agg(F.max(F.size(features))).first()[0]
    if width is None or width < 1:
        raise ValueError("no rows with features")
    if width > MOST_FEATURES:
        raise ValueError(f"{width} features: the normal equations take {MOST_FEATURES} at most")
    x = F.transform(F.col(features), lambda v: v.cast("double"))
    used = rows.where(usable(F.col(features), F.col(label), width)).select(
        x.alias("x"), F.col(label).cast("double").alias("y"), F.coalesce(valid, F.lit(False)).alias("valid"))
    betas = [np.zeros(width + 1) for _ in reg_params]
    trace = []
    for step in range(steps + 1):
        sums = step_sums(used, betas, delta, start=step == 0)
        if step:
            trace += [(reg, step, *(float(t / n) if n else None for n, t in (s[-4:-2], s[-2:]))) for reg, s in zip(reg_params, sums)]
        if step < steps:
            betas = [_solve(s, width + 1, reg) for s, reg in zip(sums, reg_params)]
    last = trace[-len(betas):]
    best = min(range(len(betas)), key=lambda i: (last[i][3] if last[i][3] is not None else float("inf"), i))
    path = {reg: tuple(map(float, b)) for reg, b in zip(reg_params, betas)}
    return HuberModel(path[reg_params[best]], reg_params[best], delta, tuple(trace), path)
