"""Numeric column helpers: potency, activations and per-row losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOMOLAR = 1e-9
HUBER_DELTA = 0.5


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pic(value: str | Column, scale: float = NANOMOLAR) -> Column:
    """-log10(value * scale): potency from a concentration (nM by default)."""
    return -F.log10(_col(value) * F.lit(scale))


def is_finite(x: str | Column) -> Column:
    """True for real, finite numbers; NULL, NaN and +-inf are False."""
    c = _col(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def silu(x: str | Column) -> Column:
    c = _col(x)
    return c / (F.lit(1.0) + F.exp(-c))


def relu(x: str | Column) -> Column:
    return F.greatest(_col(x), F.lit(0.0))


def silu_vec(v: str | Column) -> Column:
    """SiLU on every element of an array column."""
    return F.transform(_col(v), lambda x: x / (F.lit(1.0) + F.exp(-x)))


def relu_vec(v: str | Column) -> Column:
    return F.transform(_col(v), lambda x: F.greatest(x, F.lit(0.0)))


def add_vec(a: str | Column, b: str | Column) -> Column:
    """Element-wise sum of two equal-length arrays (residual connection)."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def huber(error: str | Column, delta: float = HUBER_DELTA) -> Column:
    """Huber loss of one error: 0.5 e^2 inside |e| <= delta, linear outside."""
    e = F.abs(_col(error))
    return F.when(e <= F.lit(delta), F.lit(0.5) * e * e).otherwise(
        F.lit(delta) * (e - F.lit(0.5 * delta)))


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / max(den, 1): the reference divides sums by max(1, count)."""
    return _col(num) / F.greatest(_col(den).cast("double"), F.lit(1.0))
