"""Training-run analysis: early stopping, best epoch, parameters.

Early stopping rule (per run, epochs in order, best starts at +inf):
improvement when loss < best - min_delta (best := loss, counter := 0),
regression when loss > best + min_delta (counter += 1), otherwise no change;
NaN losses change nothing. Training stops after the first epoch whose
counter reaches ``patience``; that epoch is still logged.

With ``min_delta == 0`` the best-so-far is a running minimum and the counter
is "regressions since the last improvement", so the whole rule is a few
prefix aggregates. The default runs them as distributed segmented scans
(``ranking.prefix_aggregate``): a run with an enormous epoch list is spread
over many tasks, at the price of a few extra passes on small inputs.
``method="window"`` is the plain per-run window form.

With ``min_delta > 0`` an epoch's improvement depends on the best loss before
it, but only strict running minima can be improvements. Over the minima of one
block of a run, the best loss behind the block is a step function of the best
loss before it, which the block computes alone; before a block the best loss
lies within ``min_delta`` above the running minimum, so only the steps of that
range are passed on. These are folded in order, which gives each block its
entry, and the blocks then mark their improvements side by side. The counters
are the same scans as before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.ranking import number_blocks, prefix_aggregate
from assaykit.session import ship_package, stored

PATIENCE = 2
MIN_DELTA = 0.0


def _finite(c):
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def early_stopping(df: DataFrame, run: str = "run_id", epoch: str = "epoch",
                   loss: str = "valid_loss", patience: int = PATIENCE,
                   min_delta: float = MIN_DELTA, method: str = "scan") -> DataFrame:
    """Per-epoch trace up to the stop: best_loss, best_epoch, counter, improved, stop.

    ``min_delta == 0``: ``method="scan"`` (default) runs the running minimum
    and counters as distributed prefix scans (``ranking.prefix_aggregate``),
    so a run with a very long epoch list is spread over many tasks;
    ``method="window"`` uses plain per-run windows. ``min_delta > 0`` is a
    scan of step functions (see above).
    """
    if min_delta < 0:
        raise ValueError("min_delta must not be negative")
    if min_delta > 0:
        return _early_stopping_steps(df, run, epoch, loss, patience, min_delta)
    if method == "scan":
        return _early_stopping_scan(df, run, epoch, loss, patience)
    order = Window.partitionBy(run).orderBy(epoch)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lc = F.col(loss)
    prev_best = F.coalesce(F.min(_finite(lc)).over(before), F.lit(float("inf")))
    t = df.select(run, epoch, loss).withColumn("_prev", prev_best)
    valid = ~F.isnan(lc) & lc.isNotNull()
    t = (t.withColumn("improved", valid & (lc < F.col("_prev")))
         .withColumn("_regressed", (valid & (lc > F.col("_prev"))).cast("int"))
         .withColumn("_seg", F.sum(F.col("improved").cast("int")).over(upto)))
    seg = Window.partitionBy(run, "_seg").orderBy(epoch).rowsBetween(Window.unboundedPreceding,
                                                                        Window.currentRow)
    t = (t.withColumn("counter", F.sum("_regressed").over(seg).cast("int"))
         .withColumn("best_loss", F.least(F.col("_prev"), F.when(F.col("improved"), lc)))
         .withColumn("best_epoch", F.max(F.when(F.col("improved"), F.col(epoch))).over(upto))
         .withColumn("stop", F.col("counter") >= patience))
    first_stop = F.min(F.when(F.col("stop"), F.col(epoch))).over(Window.partitionBy(run))
    return (t.withColumn("_first_stop", first_stop)
            .where(F.col("_first_stop").isNull() | (F.col(epoch) <= F.col("_first_stop")))
            .select(run, epoch, loss, "improved", "best_loss", "best_epoch", "counter", "stop"))


def _early_stopping_scan(df, run, epoch, loss, patience):
    """min_delta = 0 as three prefix scans; counter = regressions since the last improvement."""
    lc = F.col(loss)
    valid = lc.isNotNull() & ~F.isnan(lc)
    # Numbered once; each scan's result is written, since the next one reads it twice.
    base = number_blocks(df.select(run, epoch, loss), [run], [epoch])
    a = prefix_aggregate(base, [run], [epoch], {"_prev": ("min", _finite(lc))}, inclusive=False, numbered=True)
    prev = F.coalesce(F.col("_prev"), F.lit(float("inf")))
    a = stored(a.withColumn("_prev", prev)
               .withColumn("improved", valid & (lc < F.col("_prev")))
               .withColumn("_reg", (valid & (lc > F.col("_prev"))).cast("bigint")), "scan")
    return _counted(a, run, epoch, loss, patience)


def _counted(a, run, epoch, loss, patience):
    """The trace from a stored, numbered frame with improved, _reg (0/1) and _prev (best loss before)."""
    lc = F.col(loss)
    b = stored(prefix_aggregate(a, [run], [epoch], {
        "_r": ("sum", F.col("_reg")),
        "best_epoch": ("max", F.when(F.col("improved"), F.col(epoch))),
    }, numbered=True), "scan")
    # regressions counted at the last improvement (R only grows, so a running max finds it)
    c = prefix_aggregate(b, [run], [epoch], {"_rk": ("max", F.when(F.col("improved"), F.col("_r")))}, numbered=True)
    t = (c.withColumn("counter", (F.col("_r") - F.coalesce(F.col("_rk"), F.lit(0))).cast("int"))
         .withColumn("best_loss", F.when(F.col("improved"), lc).otherwise(F.col("_prev")))
         .withColumn("stop", F.col("counter") >= patience))
    first = t.groupBy(F.col(run).alias("_run")).agg(F.min(F.when(F.col("stop"), F.col(epoch))).alias("_first_stop"))
    return (t.join(first, F.col(run).eqNullSafe(F.col("_run")))
            .where(F.col("_first_stop").isNull() | (F.col(epoch) <= F.col("_first_stop")))
            .select(run, epoch, loss, "improved", "best_loss", F.col("best_epoch").cast(
                dict(a.dtypes)[epoch]).alias("best_epoch"), "counter", "stop"))


def _next_below(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of the first of the falling values ``v`` that is below each ``x``."""
    return np.searchsorted(-v, -x, side="right")


def _early_stopping_steps(df, run, epoch, loss, patience, min_delta):
    """min_delta > 0: strict minima as step functions by block, folded, then the same scans as for 0."""
    ship_package(df.sparkSession)
    lc, infinite = F.col(loss), F.lit(float("inf"))
    valid = lc.isNotNull() & ~F.isnan(lc)
    base = number_blocks(df.select(run, epoch, lc.cast("double").alias(loss)), [run], [epoch])
    low = stored(prefix_aggregate(base, [run], [epoch], {"_low": ("min", _finite(lc))}, inclusive=False, numbered=True)
                 .withColumn("_low", F.coalesce("_low", infinite)), "scan")
    minima = low.where(valid & (lc < F.col("_low"))).select(run, "_blk", "_gi", lc.alias("_v"), "_low")
    key = minima.schema[run]
    block = minima.schema["_blk"]

    def steps(piece: pd.DataFrame) -> pd.DataFrame:
        """(a best loss whose tolerance is passed by _below ends at _exit), for the bests that can come in."""
        piece = piece.sort_values("_gi")
        v, low = piece["_v"].to_numpy(), piece["_low"].iat[0]
        after, last = _next_below(v, v - min_delta), np.arange(len(v))
        for i in range(len(v) - 1, -1, -1):
            if after[i] < len(v):
                last[i] = last[after[i]]
        n = min(len(v), int((v >= low - min_delta).sum()) + 1)
        ends = np.append(last[:n][1:] != last[:n][:-1], True)  # of the steps to one exit the lowest says all
        at = np.flatnonzero(ends)
        return pd.DataFrame({run: piece[run].iloc[:1].repeat(len(at)).to_numpy(), "_blk": piece["_blk"].iat[0],
                             "_below": v[at], "_exit": v[last[at]]})

    step_schema = T.StructType([key, block, T.StructField("_below", T.DoubleType()), T.StructField("_exit", T.DoubleType())])
    tables = minima.groupBy(run, "_blk").applyInPandas(steps, step_schema)

    def fold(batches):
        """The best loss before each block, from the steps in order; the state is two numbers."""
        now, best, moved = None, math.inf, False
        for batch in batches:
            out = []
            for r, b, below, exit_ in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or (r, b) != now:
                    if now is None or r != now[0]:
                        best = math.inf
                    now, moved = (r, b), False
                    out.append((r, b, best))
                if not moved and below < best - min_delta:
                    best, moved = exit_, True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    entry_schema = T.StructType([key, block, T.StructField("_entry", T.DoubleType())])
    arrow = to_arrow_schema(entry_schema)
    entries = tables.repartition(run).sortWithinPartitions(run, "_blk", F.col("_below").desc()).mapInArrow(fold, entry_schema)

    def mark(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values("_gi")
        entry = piece["_entry"].max()
        rows = piece[piece["_gi"].notna()]
        v, hits = rows["_v"].to_numpy(), []
        after = _next_below(v, v - min_delta)
        i = int(_next_below(v, np.array([entry - min_delta]))[0])
        while i < len(v):
            hits.append(i)
            i = int(after[i])
        return pd.DataFrame({"_gi": rows["_gi"].to_numpy()[hits].astype("int64")})

    both = minima.select(run, "_blk", "_gi", "_v", F.lit(None).cast("double").alias("_entry")).unionByName(
        entries.select(run, "_blk", "_entry"), allowMissingColumns=True)
    hits = both.groupBy(run, "_blk").applyInPandas(mark, "_gi long").withColumn("improved", F.lit(True))
    marked = low.drop("_low").join(hits, "_gi", "left").withColumn("improved", F.coalesce("improved", F.lit(False)))
    best = prefix_aggregate(stored(marked, "improved"), [run], [epoch],
                            {"_prev": ("min", F.when(F.col("improved"), lc))}, inclusive=False, numbered=True)
    a = best.withColumn("_prev", F.coalesce("_prev", infinite)).withColumn(
        "_reg", (valid & ~F.col("improved") & (lc > F.col("_prev") + F.lit(min_delta))).cast("bigint"))
    return _counted(stored(a, "scan"), run, epoch, loss, patience)


def best_epoch(trace: DataFrame, run: str = "run_id", epoch: str = "epoch",
               loss: str = "valid_loss") -> DataFrame:
    """Per run, the checkpoint kept: the last improvement before stopping."""
    last = trace.where(F.col("improved")).groupBy(run).agg(
        F.max(F.struct(F.col(epoch), F.col(loss)).alias("s")).alias("s"),
        F.count(F.lit(1)).alias("n_improvements"))
    stats = trace.groupBy(run).agg(F.max(epoch).alias("last_epoch"),
                                   F.max(F.col("stop").cast("int")).cast("boolean").alias("stopped_early"))
    return (stats.join(last, run, "left")
            .select(run, F.col("s")[epoch].alias("best_epoch"), F.col("s")[loss].alias("best_loss"),
                    F.coalesce("n_improvements", F.lit(0)).alias("n_improvements"),
                    "last_epoch", "stopped_early"))


def run_params(df: DataFrame, keys: Sequence[str], run: str = "run_id", key: str = "key",
               value: str = "value") -> DataFrame:
    """Long (run, key, value) -> one row per run with a column per key.

    The key list is explicit, so the pivot needs no extra job to find it.
    """
    return df.groupBy(run).pivot(key, list(keys)).agg(F.max(value))


def batch_count(df: DataFrame, batch_size: int, drop_last: bool = True) -> DataFrame:
    """Number of mini-batches of ``batch_size`` rows: floor or ceil."""
    n = F.count(F.lit(1))
    nb = F.floor(n / F.lit(batch_size)) if drop_last else F.ceil(n / F.lit(batch_size))
    return df.agg(n.alias("n_rows"), nb.cast("bigint").alias("n_batches"))
