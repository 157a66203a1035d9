"""Registered queries: graph tables, fingerprints, propagation, tensor decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.functions import numeric
from assaykit.operators import graphs as G
from assaykit.plans.catalog import register
from assaykit.sources import fixtures as fx

FEATS = ("f0", "f1")

_DIRECTED_SQL = "m AS (SELECT gid, src, dst FROM edges UNION ALL SELECT gid, dst AS src, src AS dst FROM edges)"
_DEGREE_SQL = f"""{_DIRECTED_SQL},
dc AS (SELECT gid, src AS nid, count(*) AS degree FROM m GROUP BY gid, src),
deg AS (SELECT n.gid, n.nid, coalesce(dc.degree, 0) AS degree FROM nodes n LEFT JOIN dc USING (gid, nid))"""


@register("node_degree", f"WITH {_DEGREE_SQL} SELECT gid, nid, degree FROM deg")
def q_node_degree(spark, base):
    return G.node_degree(fx.nodes(spark, base), fx.edges(spark, base))


_ASSEMBLE_SQL = """
p AS (SELECT gid, nid, f0, f1, row_number() OVER (PARTITION BY gid ORDER BY nid) - 1 AS pos FROM nodes),
nf AS (SELECT gid, list([CAST(f0 AS FLOAT), CAST(f1 AS FLOAT)] ORDER BY pos) AS node_features FROM p GROUP BY gid),
b AS (SELECT e.gid, ps.pos AS i, pd.pos AS j FROM edges e JOIN p ps ON ps.gid = e.gid AND ps.nid = e.src
      JOIN p pd ON pd.gid = e.gid AND pd.nid = e.dst),
bl AS (SELECT gid, flatten(list([i, j] ORDER BY i, j)) AS s, flatten(list([j, i] ORDER BY i, j)) AS d
       FROM b GROUP BY gid),
ag AS (SELECT nf.gid, nf.node_features,
         [coalesce(bl.s, CAST([] AS BIGINT[])), coalesce(bl.d, CAST([] AS BIGINT[]))] AS edge_index
       FROM nf LEFT JOIN bl USING (gid))"""


@register("assemble_graphs", f"WITH {_ASSEMBLE_SQL.strip()} SELECT * FROM ag")
def q_assemble_graphs(spark, base):
    return G.assemble_graphs(fx.nodes(spark, base), fx.edges(spark, base), FEATS)


@register("feature_width", f"""
WITH {_ASSEMBLE_SQL.strip()},
w AS (SELECT len(unnest(node_features)) AS w FROM ag)
SELECT CAST(min(w) AS INTEGER) AS min_width, CAST(max(w) AS INTEGER) AS max_width, min(w) = max(w) AS consistent FROM w""")
def q_feature_width(spark, base):
    return G.feature_width(G.assemble_graphs(fx.nodes(spark, base), fx.edges(spark, base), FEATS))


@register("mean_pool", """
SELECT gid, [round(avg(f0), 9), round(avg(f1), 9)] AS pooled FROM nodes GROUP BY gid""")
def q_mean_pool(spark, base):
    pooled = G.mean_pool_columns(fx.nodes(spark, base), FEATS)
    return pooled.select("gid", F.transform("pooled", lambda x: F.round(x, 9)).alias("pooled"))


def _round_sql(i: int) -> str:
    silu = "{v} / (1 + exp(-{v}))"
    return f"""
r{i} AS (SELECT w.gid, w.dst AS nid, sum(h.a * w.w) AS a, sum(h.b * w.w) AS b
  FROM w JOIN h{i - 1} h ON h.gid = w.gid AND h.nid = w.src GROUP BY w.gid, w.dst),
s{i} AS (SELECT gid, nid, {silu.format(v='a')} AS a, {silu.format(v='b')} AS b FROM r{i})"""


_PROP_SQL = f"""
{_DEGREE_SQL},
d AS (SELECT gid, nid, CAST(degree + 1 AS DOUBLE) AS d FROM deg),
links AS (SELECT gid, src, dst FROM m UNION ALL SELECT gid, nid, nid FROM nodes),
w AS (SELECT l.gid, l.src, l.dst, 1.0 / sqrt(ds.d * dd.d) AS w FROM links l
      JOIN d ds ON ds.gid = l.gid AND ds.nid = l.src JOIN d dd ON dd.gid = l.gid AND dd.nid = l.dst),
h0 AS (SELECT gid, nid, CAST(f0 AS DOUBLE) AS a, CAST(f1 AS DOUBLE) AS b FROM nodes),
{_round_sql(1).strip()},
h1 AS (SELECT * FROM s1),
{_round_sql(2).strip()},
h2 AS (SELECT s2.gid, s2.nid, h1.a + s2.a AS a, h1.b + s2.b AS b FROM s2 JOIN h1 USING (gid, nid))"""


@register("propagate", f"""
WITH {_PROP_SQL.strip()}
SELECT gid, nid, round(a, 6) AS f0, round(b, 6) AS f1 FROM h2""")
def q_propagate(spark, base):
    h = G.propagate(fx.nodes(spark, base), fx.edges(spark, base), FEATS, k=2, activation="silu", residual=True)
    return h.select("gid", "nid", *[F.round(c, 6).alias(c) for c in FEATS])


def _fp_round_sql(r: int) -> str:
    return f"""
nb{r} AS (SELECT m.gid, m.dst AS nid, sum(i.id) AS s, count(*) AS c FROM m JOIN id{r - 1} i
          ON i.gid = m.gid AND i.nid = m.src GROUP BY m.gid, m.dst),
id{r} AS (SELECT i.gid, i.nid, ('0x' || substring(md5('{r}:' || CAST(i.id AS VARCHAR) || ':' ||
          CAST(coalesce(nb{r}.s, 0) AS VARCHAR) || ':' || CAST(coalesce(nb{r}.c, 0) AS VARCHAR)), 1, 8))::BIGINT AS id
          FROM id{r - 1} i LEFT JOIN nb{r} USING (gid, nid))"""


_FP_SQL = f"""
{_DIRECTED_SQL},
inv AS (SELECT gid, nid, coalesce(CAST(CAST(round(g0 * 1000000) AS BIGINT) AS VARCHAR), '-') || '|' ||
               coalesce(CAST(CAST(round(g1 * 1000000) AS BIGINT) AS VARCHAR), '-') AS s
        FROM (SELECT gid, nid, CASE WHEN nid % 5 = 1 THEN NULL ELSE f0 END AS g0,
                     CASE WHEN nid % 5 = 2 THEN NULL ELSE f1 + (gid % 7) / 10000.0::DOUBLE END AS g1 FROM nodes) g),
id0 AS (SELECT gid, nid, ('0x' || substring(md5('0:' || s), 1, 8))::BIGINT AS id FROM inv),
{_fp_round_sql(1).strip()},
{_fp_round_sql(2).strip()},
allids AS (SELECT gid, id FROM id0 UNION ALL SELECT gid, id FROM id1 UNION ALL SELECT gid, id FROM id2),
bitset AS (SELECT DISTINCT gid, CAST(id % 2048 AS INTEGER) AS bit FROM allids),
fp AS (SELECT gid, list(bit ORDER BY bit) AS bits FROM bitset GROUP BY gid)"""


def _fingerprint_nodes(spark, base):
    """Nodes whose features have gaps in either place and differ in the fourth decimal."""
    n = fx.nodes(spark, base)
    return n.select("gid", "nid", F.when(F.col("nid") % 5 != 1, F.col("f0")).alias("f0"),
                    F.when(F.col("nid") % 5 != 2, F.col("f1") + (F.col("gid") % 7) / F.lit(10000.0)).alias("f1"))


@register("circular_fingerprint", f"WITH {_FP_SQL.strip()} SELECT gid, bits FROM fp")
def q_circular_fingerprint(spark, base):
    return G.circular_fingerprint(_fingerprint_nodes(spark, base), fx.edges(spark, base), FEATS, radius=2,
                                  n_bits=2048, decimals=6)


@register("densify_bits", f"""
WITH {_FP_SQL.strip()}
SELECT gid, CAST(list_transform(range(2048), lambda i: CASE WHEN list_contains(bits, CAST(i AS INTEGER)) THEN 1 ELSE 0 END)
            AS TINYINT[]) AS fingerprint FROM fp""")
def q_densify_bits(spark, base):
    fp = G.circular_fingerprint(_fingerprint_nodes(spark, base), fx.edges(spark, base), FEATS, decimals=6)
    return G.densify_bits(fp, "bits", 2048, "fingerprint").select("gid", "fingerprint")


@register("decode_features", """
SELECT name, vec_id, CAST(generate_subscripts("values", 1) - 1 AS INTEGER) AS position,
       unnest("values") AS value FROM tensors""")
def q_decode_features(spark, base):
    return G.decode_features(fx.tensors(spark, base), "values", ["name", "vec_id"])


@register("activations", """
SELECT vec_id,
  list_transform("values", lambda x: round(CAST(x AS DOUBLE) / (1 + exp(-CAST(x AS DOUBLE))), 6)) AS silu,
  list_transform("values", lambda x: round(greatest(CAST(x AS DOUBLE), 0.0::DOUBLE), 6)) AS relu,
  list_transform("values", lambda x: round(CAST(x AS DOUBLE) + CAST(x AS DOUBLE) / (1 + exp(-CAST(x AS DOUBLE))), 6))
    AS residual FROM tensors""")
def q_activations(spark, base):
    t = fx.tensors(spark, base).select("vec_id", F.transform("values", lambda x: x.cast("double")).alias("v"))
    rnd = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return t.select("vec_id", rnd(numeric.silu_vec("v")).alias("silu"), rnd(numeric.relu_vec("v")).alias("relu"),
                    rnd(numeric.add_vec("v", numeric.silu_vec("v"))).alias("residual"))
