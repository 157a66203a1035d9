"""Registered queries: distributions, regression metrics, run analysis, batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.operators import batching as B
from assaykit.operators import cleaning as C
from assaykit.operators import distributions as D
from assaykit.operators import joins as J
from assaykit.operators import metrics as M
from assaykit.operators import runs as R
from assaykit.plans.catalog import register
from assaykit.plans.queries_core import _CLEAN_ACTIVITY_SQL, _bucket_sql
from assaykit.session import shared_path
from assaykit.sources import fixtures as fx
from assaykit.sources.tables import read_table

TYPES = C.STANDARD_TYPES
_TYPES_SQL = ", ".join(f"'{t}'" for t in TYPES)

_MOLAR_SQL = """CASE lower(trim({u})) WHEN 'm' THEN 1.0 WHEN 'mm' THEN 1e-3 WHEN 'um' THEN 1e-6
  WHEN 'µm' THEN 1e-6 WHEN 'nm' THEN 1e-9 WHEN 'pm' THEN 1e-12 END::DOUBLE"""


def _log_sql(type_cond: str, annotate: bool) -> str:
    """CTEs meas -> (ann) -> cons -> logv, the DuckDB twin of ``_log_values``."""
    src = "meas"
    ann = ""
    if annotate:
        ann = """
ann AS (SELECT m.*, cs.component_type FROM meas m LEFT JOIN target_dictionary td ON td.tid = m.tid
  LEFT JOIN target_components tc ON tc.tid = td.tid
  LEFT JOIN component_sequences cs ON cs.component_id = tc.component_id),"""
        src = "ann"
    return f"""
meas AS (SELECT a.*, s.assay_organism, s.assay_type, s.assay_tax_id, s.tid FROM activity a JOIN assay s USING (assay_id)
  WHERE a.standard_type {type_cond} AND a.potential_duplicate = 0
    AND (s.assay_organism IN ('Homo sapiens','Mus musculus','Rattus norvegicus')
         OR s.assay_tax_id IN (9606, 10090, 10116))),{ann}
cons AS (SELECT *, CAST(value AS DOUBLE) * {_MOLAR_SQL.format(u='units')} AS molar,
           CAST(standard_value AS DOUBLE) * {_MOLAR_SQL.format(u='standard_units')} AS std_molar FROM {src}
  WHERE value IS NOT NULL AND units IS NOT NULL AND standard_value IS NOT NULL AND standard_units IS NOT NULL),
logv AS (SELECT * EXCLUDE (std_molar), -log10(molar) AS log_value FROM cons
  WHERE molar IS NOT NULL AND std_molar IS NOT NULL AND molar = std_molar AND molar > 0)""".strip()


def _log_values(spark, base, types, annotate: bool = False, weighted: bool = False):
    """Consistent measurements as -log10(molar), optionally annotated with target component types.

    ``weighted`` keeps one row per measurement and component type with an
    ``n_components`` multiplicity instead of one row per component.
    """
    m = J.measurement_join(fx.activity(spark, base), fx.assay(spark, base), types)
    if annotate:
        tables = (fx.target_dictionary(spark, base), fx.target_components(spark, base),
                  fx.component_sequences(spark, base))
        m = J.annotate_target_types(m, *tables) if weighted else J.annotate_targets(m, *tables)
    return C.molar_log(C.consistent_measurements(m), "molar", "log_value")


def _bin_sql(x: str, lo: str, hi: str, bins: int = 100) -> str:
    return (f"CASE WHEN {hi} > {lo} THEN LEAST(CAST(floor(({x} - {lo}) / (({hi} - {lo}) / {bins})) AS BIGINT), "
            f"{bins - 1}) ELSE 0 END")


# --- distributions (A6-A8, W2) -------------------------------------------------------------------

@register("histogram", f"""
WITH {_log_sql("= 'IC50'", False)},
r AS (SELECT min(log_value) AS lo, max(log_value) AS hi FROM logv),
c AS (SELECT {_bin_sql('log_value', 'r.lo', 'r.hi')} AS bin, count(*) AS n FROM logv, r GROUP BY 1)
SELECT g.i AS bin, round(r.lo + g.i * ((r.hi - r.lo) / 100), 9) AS lo,
       round(r.lo + (g.i + 1) * ((r.hi - r.lo) / 100), 9) AS hi, coalesce(c.n, 0) AS n
FROM range(100) g(i) CROSS JOIN r LEFT JOIN c ON c.bin = g.i WHERE r.lo IS NOT NULL""")
def q_histogram(spark, base):
    h = D.histogram(_log_values(spark, base, "IC50"), "log_value", 100)
    return h.select("bin", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n")


_DIST_SQL = f"""
WITH {_log_sql(f"IN ({_TYPES_SQL})", True)},
ex AS (SELECT standard_type, log_value, 'overall' AS dim, CAST(NULL AS VARCHAR) AS key FROM logv
  UNION ALL SELECT standard_type, log_value, 'assay_organism', assay_organism FROM logv
  UNION ALL SELECT standard_type, log_value, 'assay_type', assay_type FROM logv
  UNION ALL SELECT standard_type, log_value, 'component_type', component_type FROM logv),
rg AS (SELECT standard_type, dim, key, min(log_value) AS lo, max(log_value) AS hi FROM ex GROUP BY ALL),
bn AS (SELECT ex.standard_type, ex.dim, ex.key, rg.lo, rg.hi, {_bin_sql('ex.log_value', 'rg.lo', 'rg.hi')} AS bin
  FROM ex JOIN rg ON ex.standard_type = rg.standard_type AND ex.dim = rg.dim AND ex.key IS NOT DISTINCT FROM rg.key)
SELECT standard_type, dim, key, bin, round(lo + bin * ((hi - lo) / 100), 9) AS lo,
       round(lo + (bin + 1) * ((hi - lo) / 100), 9) AS hi, count(*) AS n
FROM bn GROUP BY standard_type, dim, key, bin, bn.lo, bn.hi"""


@register("activity_distributions", _DIST_SQL)
def q_activity_distributions(spark, base):
    lv = _log_values(spark, base, TYPES, annotate=True, weighted=True)
    d = D.activity_distributions(lv, "log_value", ["assay_organism", "assay_type", "component_type"],
                                 weight="n_components")
    return d.select("standard_type", "dim", "key", "bin", F.round("lo", 9).alias("lo"),
                    F.round("hi", 9).alias("hi"), "n")


_DIST_DISTINCT_SQL = _DIST_SQL.replace(
    "ex AS (SELECT standard_type, log_value, 'overall' AS dim, CAST(NULL AS VARCHAR) AS key FROM logv",
    "ex0 AS (SELECT standard_type, activity_id, log_value, 'overall' AS dim, CAST(NULL AS VARCHAR) AS key FROM logv"
).replace("UNION ALL SELECT standard_type, log_value,", "UNION ALL SELECT standard_type, activity_id, log_value,").replace(
    "component_type FROM logv),",
    "component_type FROM logv),\nex AS (SELECT DISTINCT standard_type, activity_id, log_value, dim, key FROM ex0),")


@register("activity_distributions_distinct", _DIST_DISTINCT_SQL)
def q_activity_distributions_distinct(spark, base):
    """A7 with each measurement counted once per key, whatever the target fan-out."""
    lv = _log_values(spark, base, TYPES, annotate=True, weighted=True)
    d = D.activity_distributions(lv, "log_value", ["assay_organism", "assay_type", "component_type"],
                                 distinct_measurements=True)
    return d.select("standard_type", "dim", "key", "bin", F.round("lo", 9).alias("lo"),
                    F.round("hi", 9).alias("hi"), "n")


@register("histogram_by_organism", f"""
WITH {_log_sql("= 'IC50'", False)},
rg AS (SELECT assay_organism, min(log_value) AS lo, max(log_value) AS hi FROM logv GROUP BY ALL),
bn AS (SELECT l.assay_organism, rg.lo, rg.hi, {_bin_sql('l.log_value', 'rg.lo', 'rg.hi')} AS bin
  FROM logv l JOIN rg ON l.assay_organism IS NOT DISTINCT FROM rg.assay_organism)
SELECT assay_organism, bin, round(lo + bin * ((hi - lo) / 100), 9) AS lo,
       round(lo + (bin + 1) * ((hi - lo) / 100), 9) AS hi, count(*) AS n
FROM bn GROUP BY assay_organism, bin, bn.lo, bn.hi""")
def q_histogram_by_organism(spark, base):
    h = D.grouped_histogram(_log_values(spark, base, "IC50"), "log_value", ["assay_organism"])
    return h.select("assay_organism", "bin", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n")


@register("top_component_types", f"""
WITH {_log_sql(f"IN ({_TYPES_SQL})", True)}
SELECT * FROM (
  SELECT standard_type, component_type, count(*) AS n,
    row_number() OVER (PARTITION BY standard_type ORDER BY count(*) DESC, component_type ASC) AS rank
  FROM logv WHERE component_type IS NOT NULL GROUP BY standard_type, component_type) t WHERE rank <= 6""")
def q_top_component_types(spark, base):
    lv = _log_values(spark, base, TYPES, annotate=True, weighted=True)
    t = D.top_groups(lv, "component_type", 6, within=["standard_type"], weight="n_components")
    return t.withColumn("rank", F.col("rank").cast("bigint"))


@register("top_customers", """
SELECT * FROM (
  SELECT tid, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tid ASC) AS rank
  FROM assay WHERE tid IS NOT NULL GROUP BY tid) t WHERE rank <= 6""")
def q_top_customers(spark, base):
    t = D.top_groups(fx.assay(spark, base), "tid", 6)
    return t.withColumn("rank", F.col("rank").cast("bigint"))


@register("cleaning_report", f"""
SELECT 0 AS stage_no, 'raw' AS stage, count(*) AS n_rows FROM activity
UNION ALL SELECT 1, 'type_and_duplicate', count(*) FROM activity
  WHERE standard_type IN ({_TYPES_SQL}) AND potential_duplicate = 0
UNION ALL SELECT 2, 'exact_ic50', count(*) FROM activity
  WHERE standard_type IN ({_TYPES_SQL}) AND potential_duplicate = 0 AND standard_type = 'IC50'
    AND standard_relation = '='
UNION ALL SELECT 3, 'complete_nm_positive', count(*) FROM activity
  WHERE standard_type IN ({_TYPES_SQL}) AND potential_duplicate = 0 AND standard_type = 'IC50'
    AND standard_relation = '=' AND {_CLEAN_ACTIVITY_SQL} AND standard_units = 'nM' AND standard_value > 0""")
def q_cleaning_report(spark, base):
    complete = F.lit(True)
    for c in C.ACTIVITY_COLUMNS:
        complete = complete & F.col(c).isNotNull()
    for c in ("standard_value", "pchembl_value", "value"):
        complete = complete & ~F.isnan(c)
    return D.filter_report(fx.activity(spark, base), {
        "raw": F.lit(True),
        "type_and_duplicate": F.col("standard_type").isin(*C.STANDARD_TYPES) & (F.col("potential_duplicate") == 0),
        "exact_ic50": (F.col("standard_type") == C.GRAPH_STANDARD_TYPE)
        & (F.col("standard_relation") == C.GRAPH_STANDARD_RELATION),
        "complete_nm_positive": complete & (F.col("standard_units") == "nM") & (F.col("standard_value") > 0)})


# --- regression metrics (P15, A9-A14) -------------------------------------------------------------

_HUBER_SQL = "CASE WHEN abs(pred - truth) <= 0.5 THEN 0.5 * (pred - truth) * (pred - truth) " \
             "ELSE 0.5 * (abs(pred - truth) - 0.25) END"


@register("row_losses", f"""
SELECT epoch, batch_id, round(truth, 9) AS truth, round(pred, 9) AS pred, round(pred - truth, 9) AS error,
  round(abs(pred - truth), 9) AS abs_error, round((pred - truth) * (pred - truth), 9) AS squared_error,
  round({_HUBER_SQL}, 9) AS huber FROM predictions""")
def q_row_losses(spark, base):
    df = M.row_losses(fx.predictions(spark, base))
    return df.select("epoch", "batch_id", *[F.round(c, 9).alias(c) for c in
                                            ("truth", "pred", "error", "abs_error", "squared_error", "huber")])


_SUMS_SQL = f"""sum(abs(pred - truth)) AS abs_error_sum, sum((pred - truth) * (pred - truth)) AS squared_error_sum,
  sum(truth) AS target_sum, sum(truth * truth) AS target_squared_sum, count(*) AS n, sum({_HUBER_SQL}) AS loss_sum"""
_SUM_COLS = ("abs_error_sum", "squared_error_sum", "target_sum", "target_squared_sum", "loss_sum")


@register("regression_sums", f"""
SELECT epoch, {', '.join(f'round({c}, 4) AS {c}' for c in _SUM_COLS)}, n FROM (
  SELECT epoch, {_SUMS_SQL} FROM predictions GROUP BY epoch) s""")
def q_regression_sums(spark, base):
    s = M.regression_sums(fx.predictions(spark, base), by=["epoch"])
    return s.select("epoch", *[F.round(c, 4).alias(c) for c in _SUM_COLS], "n")


_METRIC_COLS = ("mae", "rmse", "mse", "r2", "loss")


@register("regression_metrics", f"""
WITH s AS (SELECT epoch, batch_id,
    CASE WHEN GROUPING(epoch) = 1 THEN 0 WHEN GROUPING(batch_id) = 1 THEN 1 ELSE 2 END AS level, {_SUMS_SQL}
  FROM predictions GROUP BY ROLLUP (epoch, batch_id)),
m AS (SELECT *, abs_error_sum / greatest(CAST(n AS DOUBLE), 1.0) AS mae,
    sqrt(squared_error_sum / greatest(CAST(n AS DOUBLE), 1.0)) AS rmse,
    squared_error_sum / greatest(CAST(n AS DOUBLE), 1.0) AS mse,
    target_squared_sum - (target_sum * target_sum) / greatest(CAST(n AS DOUBLE), 1.0) AS sst,
    loss_sum / greatest(CAST(n AS DOUBLE), 1.0) AS loss FROM s)
SELECT epoch, batch_id, level, n, {', '.join(f'round({c}, 4) AS {c}' for c in _SUM_COLS)},
  round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mse, 6) AS mse,
  round(CASE WHEN n <= 1 THEN 'nan'::DOUBLE WHEN sst <= 0 THEN CASE WHEN squared_error_sum <= 1e-12 THEN 1.0 ELSE 0.0 END
        ELSE 1.0 - squared_error_sum / sst END, 6) AS r2,
  round(loss, 6) AS loss FROM m""")
def q_regression_metrics(spark, base):
    m = M.regression_metrics(fx.predictions(spark, base), levels=("epoch", "batch_id"))
    return m.select("epoch", "batch_id", "level", "n", *[F.round(c, 4).alias(c) for c in _SUM_COLS],
                    *[F.round(c, 6).alias(c) for c in _METRIC_COLS])


@register("tensor_stats", """
SELECT name, round(stddev_pop(x), 6) AS std, round(var_pop(x), 6) AS var,
  round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction, count(*) AS n_values
FROM (SELECT name, CAST(unnest("values") AS DOUBLE) AS x FROM tensors) t GROUP BY name""")
def q_tensor_stats(spark, base):
    t = M.tensor_stats(fx.tensors(spark, base))
    return t.select("name", *[F.round(c, 6).alias(c) for c in ("std", "var", "zero_fraction")], "n_values")


@register("batch_count", """
SELECT true AS drop_last, count(*) AS n_rows, CAST(floor(count(*) / 256) AS BIGINT) AS n_batches FROM predictions
UNION ALL SELECT false, count(*), CAST(ceil(count(*) / 256) AS BIGINT) FROM predictions""")
def q_batch_count(spark, base):
    p = fx.predictions(spark, base)
    a = R.batch_count(p, 256, drop_last=True).select(F.lit(True).alias("drop_last"), "n_rows", "n_batches")
    b = R.batch_count(p, 256, drop_last=False).select(F.lit(False).alias("drop_last"), "n_rows", "n_batches")
    return a.unionByName(b)


# --- run analysis (W4, W5, S15) ----------------------------------------------------------------------

_ES_SQL = """
p AS (SELECT run_id, epoch, valid_loss, coalesce(min(CASE WHEN isnan(valid_loss) THEN NULL ELSE valid_loss END)
        OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS prev
      FROM epochs),
q AS (SELECT *, (valid_loss IS NOT NULL AND NOT isnan(valid_loss) AND valid_loss < prev) AS improved,
        CAST((valid_loss IS NOT NULL AND NOT isnan(valid_loss) AND valid_loss > prev) AS INTEGER) AS regressed FROM p),
s AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY run_id ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM q),
t AS (SELECT *, CAST(sum(regressed) OVER (PARTITION BY run_id, seg ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS counter,
      CASE WHEN improved THEN valid_loss ELSE prev END AS best_loss,
      max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_epoch FROM s),
u AS (SELECT *, counter >= 2 AS stop FROM t),
trace AS (SELECT run_id, epoch, valid_loss, improved, best_loss, best_epoch, counter, stop FROM (
  SELECT *, min(CASE WHEN stop THEN epoch END) OVER (PARTITION BY run_id) AS first_stop FROM u) v
  WHERE first_stop IS NULL OR epoch <= first_stop)"""


@register("early_stopping", f"WITH {_ES_SQL.strip()} SELECT * FROM trace")
def q_early_stopping(spark, base):
    return R.early_stopping(fx.epochs(spark, base), patience=2, min_delta=0.0)


ES_DELTA = 25.0


@register("early_stopping_delta", f"""
WITH RECURSIVE e AS (SELECT run_id, epoch, valid_loss,
    row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS rn FROM epochs),
r AS (
  SELECT run_id, rn, epoch, valid_loss, improved,
    CASE WHEN improved THEN valid_loss ELSE 'inf'::DOUBLE END AS best,
    CASE WHEN improved THEN epoch END AS best_epoch, 0 AS counter, false AS stop
  FROM (SELECT *, (valid_loss IS NOT NULL AND NOT isnan(valid_loss) AND valid_loss < 'inf'::DOUBLE - {ES_DELTA})
          AS improved FROM e WHERE rn = 1) b
  UNION ALL
  SELECT run_id, rn, epoch, valid_loss, improved, best, best_epoch, counter, counter >= 2 AS stop FROM (
    SELECT e.run_id, e.rn, e.epoch, e.valid_loss, x.imp AS improved,
      CASE WHEN x.imp THEN e.valid_loss ELSE r.best END AS best,
      CASE WHEN x.imp THEN e.epoch ELSE r.best_epoch END AS best_epoch,
      CASE WHEN x.imp THEN 0 WHEN x.reg THEN r.counter + 1 ELSE r.counter END AS counter
    FROM r JOIN e ON e.run_id = r.run_id AND e.rn = r.rn + 1,
    LATERAL (SELECT (e.valid_loss IS NOT NULL AND NOT isnan(e.valid_loss) AND e.valid_loss < r.best - {ES_DELTA}) AS imp,
                    (e.valid_loss IS NOT NULL AND NOT isnan(e.valid_loss) AND NOT (e.valid_loss < r.best - {ES_DELTA})
                     AND e.valid_loss > r.best + {ES_DELTA}) AS reg) x
    WHERE NOT r.stop) n)
SELECT run_id, epoch, valid_loss, improved, best AS best_loss, best_epoch, counter, stop FROM r""")
def q_early_stopping_delta(spark, base):
    return R.early_stopping(fx.epochs(spark, base), patience=2, min_delta=ES_DELTA)


@register("best_epoch", f"""
WITH {_ES_SQL.strip()},
st AS (SELECT run_id, max(epoch) AS last_epoch, bool_or(stop) AS stopped_early FROM trace GROUP BY run_id),
la AS (SELECT run_id, max(epoch) AS best_epoch, arg_max(valid_loss, epoch) AS best_loss, count(*) AS n_improvements
       FROM trace WHERE improved GROUP BY run_id)
SELECT st.run_id, la.best_epoch, la.best_loss, coalesce(la.n_improvements, 0) AS n_improvements,
       st.last_epoch, st.stopped_early FROM st LEFT JOIN la USING (run_id)""")
def q_best_epoch(spark, base):
    return R.best_epoch(R.early_stopping(fx.epochs(spark, base)))


PARAM_KEYS = ("brand", "type", "name", "size")


@register("run_params", "SELECT run_id, " + ", ".join(
    f"max(CASE WHEN key = '{k}' THEN value END) AS {k}" for k in PARAM_KEYS) + " FROM params GROUP BY run_id")
def q_run_params(spark, base):
    return R.run_params(fx.params(spark, base), PARAM_KEYS)


# --- dataset serving (W6-W8) -----------------------------------------------------------------------

@register("assign_batches", """
WITH x AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events),
n AS (SELECT count(*) AS n FROM events)
SELECT event_id, row_index, CAST(floor(row_index / 256) AS BIGINT) AS batch_id FROM x, n
WHERE row_index < floor(n / 256) * 256""")
def q_assign_batches(spark, base):
    ev = read_table(spark, base, "events").select("event_id")
    return B.assign_batches(ev, ["event_id"], 256, drop_last=True)


@register("assign_batches_keep_last", """
SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index,
  CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 100) AS BIGINT) AS batch_id FROM events""")
def q_assign_batches_keep_last(spark, base):
    ev = read_table(spark, base, "events").select("event_id")
    return B.assign_batches(ev, ["event_id"], 100, drop_last=False)


@register("seeded_shuffle", f"""
SELECT event_id, row_number() OVER (ORDER BY {_bucket_sql('event_id', 7)}, event_id) - 1 AS position FROM events""")
def q_seeded_shuffle(spark, base):
    ev = read_table(spark, base, "events").select("event_id")
    return B.seeded_shuffle(ev, "event_id", seed=7)


@register("assign_shards", """
SELECT event_id, CAST(event_id % 8 % 3 AS INTEGER) AS worker FROM events""")
def q_assign_shards(spark, base):
    """Eight files, in the order of their names, dealt to three workers."""
    path = shared_path(spark, "shards")
    ev = read_table(spark, base, "events").select("event_id", (F.col("event_id") % 8).alias("part"))
    ev.repartition(8, "part").write.partitionBy("part").parquet(path)
    files = spark.read.schema("event_id long, part long").parquet(path)
    return B.assign_shards(files, 3).select("event_id", "worker")
