"""Registered queries: token graphs, model fits and predictions.

Fits whose steps are aggregates have a SQL twin, unrolled step by step; the
Spark ML fit has none, and the unit tests check its values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from assaykit.operators import graphs as G
from assaykit.operators import metrics as M
from assaykit.operators import models as Mo
from assaykit.operators import registry as Rg
from assaykit.operators import robust as Rb
from assaykit.operators import runs as R
from assaykit.operators import splits as X
from assaykit.operators import structures as S
from assaykit.plans.catalog import register
from assaykit.plans.queries_core import FLAGSHIP_SQL, _bucket_sql, flagship
from assaykit.plans.queries_graph import _FP_SQL, FEATS, _fingerprint_nodes
from assaykit.plans.queries_reports import _ES_SQL
from assaykit.session import shared_path, stored
from assaykit.sources import fixtures as fx

def demo_layers(width: int = 64, hidden: int = 16, seed: int = 0):
    """Deterministic small weight stack for the dense-layer query and tests."""
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, 0.1, (width, hidden)), np.zeros(hidden)),
            (rng.normal(0, 0.1, (hidden, 1)), np.zeros(1))]


TOKEN_FEATURES = ("f_len", "f_degree", "f_charge", "f_vowels", "f_upper", "f_digits")


def _structure_graphs(spark, base):
    # Featurise only molecules that still have a label (the semi-join the optimizer cannot do).
    labels = flagship(spark, base).select("molregno", "pIC", "split")
    structs = fx.compound_struct(spark, base).join(labels.select("molregno"), "molregno", "left_semi")
    return S.token_graphs(structs), labels


_TOKENS = "string_split_regex(trim(canonical_smiles), '\\s+')"
STRUCTURE_GRAPHS_SQL = f"""
WITH tok AS (
  SELECT molregno, unnest({_TOKENS}) AS w, generate_subscripts({_TOKENS}, 1) - 1 AS i, len({_TOKENS}) AS n
  FROM compound_struct WHERE canonical_smiles IS NOT NULL AND trim(canonical_smiles) <> ''),
nf AS (SELECT molregno, max(n) AS n, list([CAST(length(w) AS FLOAT),
    CAST((CASE WHEN i > 0 THEN 1 ELSE 0 END) + (CASE WHEN i < n - 1 THEN 1 ELSE 0 END) AS FLOAT),
    CAST(0 AS FLOAT),
    CAST(length(w) - length(regexp_replace(lower(w), '[aeiou]', '', 'g')) AS FLOAT),
    CAST(CASE WHEN regexp_matches(w, '^[A-Z]') THEN 1 ELSE 0 END AS FLOAT),
    CAST(length(w) - length(regexp_replace(w, '[0-9]', '', 'g')) AS FLOAT)] ORDER BY i) AS node_features
  FROM tok GROUP BY molregno)
SELECT molregno, node_features,
  [flatten(list_transform(range(n - 1), lambda k: [k, k + 1])),
   flatten(list_transform(range(n - 1), lambda k: [k + 1, k]))] AS edge_index FROM nf"""


@register("structure_graphs", STRUCTURE_GRAPHS_SQL)
def q_structure_graphs(spark, base):
    return S.token_graphs(fx.compound_struct(spark, base))


_BLANK = "coalesce(trim(canonical_smiles), '') = ''"
_BAD = "regexp_matches(trim(canonical_smiles), '[^A-Za-z\\s]')"


@register("validate_structures", f"""
SELECT molregno,
  CASE WHEN {_BLANK} OR {_BAD} THEN false ELSE true END AS is_valid,
  CASE WHEN {_BLANK} OR {_BAD} THEN NULL
       ELSE regexp_replace(lower(trim(canonical_smiles)), '\\s+', ' ', 'g') END AS canonical,
  CASE WHEN {_BLANK} THEN 'SMILES is empty.' WHEN {_BAD} THEN 'unsupported characters' END AS issue
FROM compound_struct""")
def q_validate_structures(spark, base):
    return S.validate_tokens(fx.compound_struct(spark, base))


@register("fingerprint_baseline")
def q_fingerprint_baseline(spark, base):
    graphs, labels = _structure_graphs(spark, base)
    nodes, edges = S.graph_tables(graphs, "molregno", TOKEN_FEATURES)
    bits = G.circular_fingerprint(nodes, edges, TOKEN_FEATURES, radius=2, n_bits=2048)
    rows = bits.withColumnRenamed("gid", "molregno").join(labels, "molregno").select("molregno", "pIC", "split", "bits")
    data = Mo.sparse_bits(stored(rows, "features"), "bits", 2048)
    model = Mo.fit_baseline(data.where(F.col("split") == "train"), "features", "pIC", regParam=0.1, solver="l-bfgs", maxIter=50)
    return Mo.predict_table(data.where(F.col("split") == "val"), model).select(
        "molregno", "pIC", F.col("prediction").alias("predicted_pIC"))


# --- robust regression on pooled propagated features (M2) ------------------------------------

_X = tuple(f"x{i}" for i in range(len(TOKEN_FEATURES)))


def _pooled_sql() -> str:
    """CTEs up to ``data``: pooled token features after two rounds of propagation, with label and split."""
    def per_feature(text: str) -> str:
        return ", ".join(text.format(c=c) for c in _X)

    silu = "{c} / (1 + exp(-{c})) AS {c}"
    return f"""
sg AS MATERIALIZED ({STRUCTURE_GRAPHS_SQL}),
n0 AS MATERIALIZED (SELECT molregno, i AS nid, n, {", ".join(f"CAST(f[{k + 1}] AS DOUBLE) AS x{k}" for k in range(len(_X)))}
  FROM (SELECT molregno, unnest(node_features) AS f, generate_subscripts(node_features, 1) - 1 AS i,
               len(node_features) AS n FROM sg) u),
lk AS (SELECT molregno, n, nid AS src, unnest([nid - 1, nid, nid + 1]) AS dst FROM n0),
lw AS MATERIALIZED (SELECT molregno, src, dst, 1.0 / sqrt(ds * dd) AS w FROM (
  SELECT *, CAST(1 + CASE WHEN src > 0 THEN 1 ELSE 0 END + CASE WHEN src < n - 1 THEN 1 ELSE 0 END AS DOUBLE) AS ds,
         CAST(1 + CASE WHEN dst > 0 THEN 1 ELSE 0 END + CASE WHEN dst < n - 1 THEN 1 ELSE 0 END AS DOUBLE) AS dd
  FROM lk WHERE dst BETWEEN 0 AND n - 1) z),
r1 AS (SELECT lw.molregno, lw.dst AS nid, {per_feature("sum(h.{c} * lw.w) AS {c}")}
  FROM lw JOIN n0 h ON h.molregno = lw.molregno AND h.nid = lw.src GROUP BY lw.molregno, lw.dst),
h1 AS MATERIALIZED (SELECT molregno, nid, {per_feature(silu)} FROM r1),
r2 AS (SELECT lw.molregno, lw.dst AS nid, {per_feature("sum(h.{c} * lw.w) AS {c}")}
  FROM lw JOIN h1 h ON h.molregno = lw.molregno AND h.nid = lw.src GROUP BY lw.molregno, lw.dst),
h2 AS (SELECT r2.molregno, r2.nid, {per_feature("h1.{c} + r2.{c} / (1 + exp(-r2.{c})) AS {c}")}
  FROM r2 JOIN h1 USING (molregno, nid)),
pool AS (SELECT molregno, {per_feature("avg({c}) AS {c}")} FROM h2 GROUP BY molregno),
lab AS MATERIALIZED ({FLAGSHIP_SQL.strip()}),
data AS MATERIALIZED (SELECT lab.molregno, lab.pIC AS y, split, {_bucket_sql("lab.molregno", 43)} < {int(round(0.2 * 4294967296))} AS valid,
  {", ".join(_X)} FROM pool JOIN lab USING (molregno))"""


def huber_sql(rows: str, columns: tuple[str, ...], delta: float, regs: tuple[float, ...], steps: int) -> str:
    """CTEs b0..b{steps} (reg, c0.., loss_train, loss_valid): reweighted least squares on ``rows`` (y, valid, columns)."""
    x = [*(f"t.{c}" for c in columns), "1.0::DOUBLE"]
    width = len(x)
    error = "(t.y - (" + " + ".join(f"b.c{i} * {c}" for i, c in enumerate(x)) + "))"
    huber = f"CASE WHEN abs(e) <= {delta} THEN 0.5 * e * e ELSE {delta} * (abs(e) - 0.5 * {delta}) END"
    parts = [f"b0 AS (SELECT CAST(unnest([{', '.join(map(str, regs))}]) AS DOUBLE) AS reg, "
             + ", ".join(f"0.0::DOUBLE AS c{i}" for i in range(width)) + ")"]
    for k in range(1, steps + 1):
        weight = "1.0::DOUBLE" if k == 1 else f"{delta} / greatest(abs(e), {delta})"
        named = ", ".join(f"{c} AS z{i}" for i, c in enumerate(x))
        ridge = lambda i, j: f" + b_reg * count(*)" if i == j < width - 1 else ""
        sums = [f"sum(w * z{i} * z{j}){ridge(i, j)} AS a{i}_{j}" for i in range(width) for j in range(width)]
        sums += [f"sum(w * z{i} * y) AS a{i}_{width}" for i in range(width)]
        parts.append(f"e{k}_0 AS MATERIALIZED (SELECT b_reg AS reg, {', '.join(sums)} FROM (SELECT *, {weight} AS w FROM ("
                     f"SELECT b.reg AS b_reg, t.y, {named}, {error} AS e FROM {rows} t, b{k - 1} b WHERE NOT t.valid) q) v GROUP BY b_reg)")
        for p in range(width):
            cells = [f"a{p}_{j} / a{p}_{p} AS a{p}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}"
                     for i in range(width) for j in range(width + 1)]
            parts.append(f"e{k}_{p + 1} AS MATERIALIZED (SELECT reg, {', '.join(cells)} FROM e{k}_{p})")
        parts.append(f"b{k} AS MATERIALIZED (SELECT reg, " + ", ".join(f"a{i}_{width} AS c{i}" for i in range(width)) + f" FROM e{k}_{width})")
        parts.append(f"l{k} AS MATERIALIZED (SELECT reg, avg(h) FILTER (NOT valid) AS train_loss, avg(h) FILTER (valid) AS valid_loss "
                     f"FROM (SELECT reg, valid, {huber} AS h FROM (SELECT b.reg, t.valid, {error} AS e FROM {rows} t, b{k} b) q) v GROUP BY reg)")
    return ",\n".join(parts)


_ROBUST_CTES = (f"WITH {_pooled_sql().strip()},\nfit AS (SELECT * FROM data WHERE split = 'train'),\n"
                + huber_sql("fit", _X, Rb.HUBER_DELTA, Rb.REG_PARAMS, Rb.STEPS))


def _robust_model(spark, base):
    graphs, labels = _structure_graphs(spark, base)
    nodes, edges = S.graph_tables(graphs, "molregno", TOKEN_FEATURES)
    h = G.propagate(nodes, edges, TOKEN_FEATURES, k=2, activation="silu", residual=True)
    pooled = G.mean_pool_columns(h, TOKEN_FEATURES)
    data = stored(pooled.withColumnRenamed("gid", "molregno").join(labels, "molregno").select(
        "molregno", "pIC", "split", F.col("pooled").alias("features")), "features")
    valid = X.in_sample("molregno", 0.2, 43)
    return data, Rb.fit_huber(data.where(F.col("split") == "train"), "features", "pIC", valid=valid)


@register("robust_pooled_regression", f"""
{_ROBUST_CTES},
best AS (SELECT b.* FROM b{Rb.STEPS} b JOIN l{Rb.STEPS} l USING (reg) ORDER BY valid_loss, reg LIMIT 1)
SELECT t.molregno, t.y AS pIC,
  round(c{len(_X)} + {" + ".join(f"c{i} * {c}" for i, c in enumerate(_X))}, 6) AS predicted_pIC
FROM data t, best WHERE split = 'val'""")
def q_robust_pooled_regression(spark, base):
    data, model = _robust_model(spark, base)
    return data.where(F.col("split") == "val").select(
        "molregno", "pIC", F.round(model.predict("features"), 6).alias("predicted_pIC"))


@register("robust_regression_path", f"""
{_ROBUST_CTES}
""" + " UNION ALL ".join(f"SELECT reg, {k} AS step, round(train_loss, 8) AS train_loss, round(valid_loss, 8) AS valid_loss FROM l{k}"
                         for k in range(1, Rb.STEPS + 1)))
def q_robust_regression_path(spark, base):
    """Training and validation loss of every regularisation after each step."""
    _, model = _robust_model(spark, base)
    rows = spark.createDataFrame(list(model.trace), "reg double, step int, train_loss double, valid_loss double")
    return rows.withColumns({c: F.round(c, 8) for c in ("train_loss", "valid_loss")})


@register("robust_coefficients", f"""
{_ROBUST_CTES}
SELECT reg, unnest(range({len(_X) + 1})) AS position, unnest([{", ".join(f"round(c{i}, 6) + 0.0" for i in range(len(_X) + 1))}]) AS coefficient
FROM b{Rb.STEPS}""")
def q_robust_coefficients(spark, base):
    """The coefficients of every regularisation, the intercept last."""
    _, model = _robust_model(spark, base)
    rows = [(reg, i, c) for reg, cs in model.path.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "reg double, position long, coefficient double").withColumn(
        "coefficient", F.round("coefficient", 6) + F.lit(0.0))


# --- baseline on fingerprints, checked by its normal equations (M1) ---------------------------

RIDGE_BITS, RIDGE_REG = 16, 0.1
_BITS = tuple(f"x{i}" for i in range(RIDGE_BITS))
_RIDGE_CTES = f"""
WITH {_FP_SQL.strip()},
folded AS (SELECT gid, list_transform(bits, lambda b: b % {RIDGE_BITS}) AS f FROM fp),
data AS MATERIALIZED (SELECT gid, log10(o_totalprice) AS y, {_bucket_sql("gid", 43)} < {int(round(0.2 * 4294967296))} AS valid,
  {", ".join(f"CASE WHEN list_contains(f, {i}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}" for i, c in enumerate(_BITS))}
  FROM folded JOIN orders ON o_orderkey = gid),
{huber_sql("data", _BITS, 1e9, (f"(SELECT {RIDGE_REG} / stddev_pop(y) FROM data WHERE NOT valid)",), 1)},
said AS (SELECT valid, y, c{RIDGE_BITS} + {" + ".join(f"c{i} * {c}" for i, c in enumerate(_BITS))} AS p FROM data, b1)"""


def _ridge(spark, base):
    """Least squares with a ridge on folded fingerprints: (rows with features, model).

    Spark divides the regularisation by the label's standard deviation; the SQL does so too.
    """
    from assaykit.sources.tables import read_table

    bits = G.circular_fingerprint(_fingerprint_nodes(spark, base), fx.edges(spark, base), FEATS, n_bits=RIDGE_BITS, decimals=6)
    price = read_table(spark, base, "orders").select(F.col("o_orderkey").alias("gid"), F.log10("o_totalprice").alias("label"))
    rows = stored(bits.join(price, "gid").withColumn("valid", X.in_sample("gid", 0.2, 43)), "features")
    data = Mo.sparse_bits(rows, "bits", RIDGE_BITS)
    return data, Mo.fit_baseline(data.where(~F.col("valid")), "features", "label", regParam=RIDGE_REG, standardization=False,
                                 solver="normal")


@register("baseline_metrics", f"""
{_RIDGE_CTES.strip()}
SELECT valid, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
  round(1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2
FROM said GROUP BY valid""")
def q_baseline_metrics(spark, base):
    """MAE, RMSE and R2 of the baseline on its training and validation rows."""
    data, model = _ridge(spark, base)
    m = M.regression_metrics(Mo.predict_table(data, model), "prediction", "label", levels=("valid",))
    return m.where("level = 1").select("valid", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


@register("baseline_coefficients", f"""
{_RIDGE_CTES.strip()}
SELECT unnest(range({RIDGE_BITS + 1})) AS position, unnest([{", ".join(f"round(c{i}, 6) + 0.0" for i in range(RIDGE_BITS + 1))}]) AS coefficient FROM b1""")
def q_baseline_coefficients(spark, base):
    """The fitted coefficients, the intercept last."""
    _, model = _ridge(spark, base)
    rows = [(i, float(c)) for i, c in enumerate([*model.coefficients, model.intercept])]
    return spark.createDataFrame(rows, "position long, coefficient double").withColumn(
        "coefficient", F.round("coefficient", 6) + F.lit(0.0))


def _values_sql(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v!r}'::DOUBLE" for v in r) + ")"
                     for r in rows)


def _dense_forward_sql() -> str:
    (w1, b1), (w2, b2) = demo_layers()
    w1_rows = [(i, k, float(w1[i, k])) for i in range(w1.shape[0]) for k in range(w1.shape[1])]
    b1_rows = [(k, float(b1[k])) for k in range(b1.shape[0])]
    w2_rows = [(k, float(w2[k, 0])) for k in range(w2.shape[0])]
    return f"""
WITH w1(i, k, w) AS (VALUES {_values_sql(w1_rows)}),
b1(k, b) AS (VALUES {_values_sql(b1_rows)}),
w2(k, w) AS (VALUES {_values_sql(w2_rows)}),
x AS (SELECT vec_id, CAST(unnest("values") AS DOUBLE) AS v, generate_subscripts("values", 1) - 1 AS i FROM tensors),
z AS (SELECT x.vec_id, w1.k, sum(x.v * w1.w) + max(b1.b) AS z FROM x JOIN w1 ON x.i = w1.i
      JOIN b1 ON b1.k = w1.k GROUP BY x.vec_id, w1.k),
a AS (SELECT vec_id, k, z / (1 + exp(-z)) AS h FROM z)
SELECT a.vec_id, round(sum(a.h * w2.w) + {float(b2[0])!r}, 9) AS score FROM a JOIN w2 ON a.k = w2.k GROUP BY a.vec_id"""


@register("dense_forward", _dense_forward_sql())
def q_dense_forward(spark, base):
    t = fx.tensors(spark, base)
    out = Mo.dense_forward(t, "values", demo_layers(), activation="silu", out="output")
    return out.select("vec_id", F.round(F.col("output")[0], 9).alias("score"))


NORM_WIDTH = 16


def demo_norm(width: int = NORM_WIDTH):
    """(gamma, beta, mean, variance) of a normalisation behind the first demo layer."""
    i = np.arange(width, dtype=float)
    return 1.0 + i / 32, i / 64 - 0.1, i / 50 - 0.15, 0.5 + i / 16


def _normalised_layers():
    (w1, b1), second = demo_layers()
    return [Mo.fold_batch_norm(w1, b1, *demo_norm()), second]


def _predict_saved_sql() -> str:
    gamma, beta, mean, variance = demo_norm()
    rows = [(k, *(float(x[k]) for x in (gamma, beta, mean, variance))) for k in range(NORM_WIDTH)]
    return _dense_forward_sql().replace(
        "a AS (SELECT vec_id, k, z / (1 + exp(-z)) AS h FROM z)",
        f"""bn(k, gamma, beta, mean, variance) AS (VALUES {_values_sql(rows)}),
y AS (SELECT vec_id, z.k, (z - mean) / sqrt(variance + 1e-5) * gamma + beta AS z FROM z JOIN bn ON bn.k = z.k),
a AS (SELECT vec_id, k, z / (1 + exp(-z)) AS h FROM y)""")


@register("predict_saved_model", _predict_saved_sql())
def q_predict_saved_model(spark, base):
    """Publish a model with its normalisation folded in, load the current version, predict the whole table (M3)."""
    root = shared_path(spark, "registry")
    Rg.publish(spark, root, _normalised_layers(), epoch=0, loss=0.0)
    layers = Rg.load_layers(spark, Rg.model_path(root, Rg.current(spark, root)))
    out = Rg.predict_layers(fx.tensors(spark, base), "values", layers, activation="silu")
    return out.select("vec_id", F.round(F.col("output")[0], 9).alias("score"))


@register("best_model", f"""
WITH {_ES_SQL.strip()}
SELECT run_id, CAST(count(*) AS BIGINT) AS version, max(epoch) AS epoch, arg_max(valid_loss, epoch) AS loss,
  2 AS n_layers, 64 AS width, 1 AS n_versions
FROM trace WHERE improved GROUP BY run_id ORDER BY count(*) DESC, run_id LIMIT 1""")
def q_best_model(spark, base):
    """The registry after the run that improved most often: each improvement is published, only the last stays."""
    trace = stored(R.early_stopping(fx.epochs(spark, base)).where("improved"), "trace")
    often = trace.groupBy("run_id").count().orderBy(F.col("count").desc(), "run_id").first()
    run = often.run_id if often else None
    root = shared_path(spark, "registry")
    for e in trace.where(F.col("run_id") == F.lit(run)).orderBy("epoch").collect():
        Rg.publish_if_better(spark, root, demo_layers(seed=e.epoch), e.epoch, e.valid_loss)
    Rg.prune(spark, root)
    return Rg.described(spark, root).select(
        F.lit(run).cast("long").alias("run_id"), "version", "epoch", "loss", "n_layers", "width",
        F.lit(len(Rg.versions(spark, root))).alias("n_versions"))


@register("val_split_assays", f"""
SELECT assay_id, assay_organism FROM assay WHERE {_bucket_sql('assay_id')} < {int(round(0.3 * 4294967296))}""")
def q_val_split_assays(spark, base):
    """Sampled validation assay ids through the id-list (semi/anti join) form of the split."""
    ids = X.hash_sample(fx.assay(spark, base), "assay_id", 0.3, 42).select("assay_id")
    train, val = X.train_val_split(fx.assay(spark, base), key="assay_id", val_ids=ids)
    return val.select("assay_id", "assay_organism")
