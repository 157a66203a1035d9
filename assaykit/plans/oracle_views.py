"""DuckDB SQL for the fixture views of ``assaykit.sources.fixtures``.

The oracle side of every registered query is plain SQL over the driver's
tables; ``with_views`` prepends the views a query mentions as CTEs.
"""

from __future__ import annotations

import re

VIEW_SQL: dict[str, str] = {
    "activity": """
SELECT l_orderkey*8+l_linenumber AS activity_id, l_orderkey AS assay_id, l_partkey AS molregno,
  CASE l_returnflag WHEN 'A' THEN 'IC50' WHEN 'R' THEN 'Ki' ELSE 'Kd' END AS standard_type,
  l_extendedprice AS standard_value,
  CASE WHEN l_suppkey % 5 = 0 THEN 'ug.mL-1' ELSE 'nM' END AS standard_units,
  CASE WHEN l_discount > 0.085 THEN '>' ELSE '=' END AS standard_relation,
  CAST(1 AS BIGINT) AS standard_flag,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE 9 - log10(l_extendedprice) END AS pchembl_value,
  CASE l_returnflag WHEN 'A' THEN 'IC50' WHEN 'R' THEN 'Ki' ELSE 'Kd' END AS type,
  CASE l_suppkey % 4 WHEN 0 THEN l_extendedprice/1000 WHEN 1 THEN l_extendedprice/1000
       WHEN 2 THEN l_extendedprice ELSE l_extendedprice*1000 END
    * CASE WHEN l_orderkey % 97 = 0 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS value,
  CASE l_suppkey % 4 WHEN 0 THEN ' µM ' WHEN 1 THEN 'umol/L' WHEN 2 THEN '10^-9M' ELSE 'pM' END AS units,
  CAST(CASE WHEN l_tax > 0.075 THEN 1 ELSE 0 END AS BIGINT) AS potential_duplicate
FROM lineitem""",
    "assay": """
SELECT o_orderkey AS assay_id, o_orderstatus AS assay_type,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'Homo sapiens'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Mus musculus' ELSE 'Danio rerio' END AS assay_organism,
  CAST(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 9606
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 10090 ELSE NULL END AS BIGINT) AS assay_tax_id,
  o_custkey AS tid, o_orderkey % 100 AS doc_id, 'A' || CAST(o_orderkey AS VARCHAR) AS chembl_id
FROM orders""",
    "compound_struct": """
SELECT p_partkey AS molregno, CASE WHEN p_partkey % 50 = 0 THEN '' WHEN p_partkey % 50 = 1 THEN NULL
       ELSE p_name END AS canonical_smiles FROM part""",
    "target_dictionary": "SELECT c_custkey AS tid FROM customer WHERE c_custkey % 10 <> 0",
    "target_components": """
SELECT DISTINCT tid, (tid * (j * 7 + 3) + j) % (SELECT count(*) FROM supplier) AS component_id
FROM (SELECT c_custkey AS tid, unnest(range(c_custkey % 4 + 1)) AS j FROM customer) p""",
    "component_sequences": """
SELECT s_suppkey AS component_id, CASE s_suppkey % 3 WHEN 0 THEN 'PROTEIN' WHEN 1 THEN 'DNA' ELSE 'RNA' END
       AS component_type FROM supplier""",
    "nodes": """
SELECT l_orderkey AS gid, l_linenumber AS nid, max(l_quantity) AS f0, max(l_discount) AS f1
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "edges": """
SELECT gid, src, dst FROM (
  SELECT gid, nid AS src, lead(nid) OVER (PARTITION BY gid ORDER BY nid) AS dst FROM nodes) e
WHERE dst IS NOT NULL""",
    "metrics": """
SELECT user_id AS run_id, event_type AS name, value,
  CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS step, ts
FROM events""",
    "epochs": "SELECT run_id, step AS epoch, value AS valid_loss FROM metrics WHERE name = 'click'",
    "params": """
SELECT p_partkey AS run_id, 'brand' AS key, p_brand AS value FROM part
UNION ALL SELECT p_partkey, 'type', p_type FROM part
UNION ALL SELECT p_partkey, 'name', p_name FROM part
UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part""",
    "tensors": "SELECT CAST(label AS VARCHAR) AS name, embedding AS \"values\", vec_id FROM embeddings",
    "predictions": """
SELECT l_linenumber AS epoch, l_suppkey AS batch_id, log10(l_extendedprice) AS truth,
  3.0::DOUBLE + l_quantity / 25 AS pred FROM lineitem""",
    "messages": "SELECT conv_id, turn, role, text FROM conversations",
    "inputs": """
SELECT d.doc_id, CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 19 = 0 THEN ' ' || chr(9)
    ELSE d.text END AS input_text,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.source END AS canonical,
  CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE d.lang || ':' || d.source END AS fixed,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE d.lang END AS canonical_fixed,
  CASE WHEN l.toxic = 1 THEN 'repair service unavailable' END AS repair_error,
  'proposal from ' || d.source AS repair_explanation,
  CASE d.doc_id % 5 WHEN 0 THEN 0.125::DOUBLE WHEN 1 THEN 1.005::DOUBLE
    ELSE CAST(length(d.text) % 100 AS DOUBLE) / 100 END AS repair_confidence,
  CASE WHEN d.doc_id % 7 = 1 THEN 6.03125::DOUBLE
    ELSE 4.0::DOUBLE + CAST(length(d.text) % 600 AS DOUBLE) / 100 END AS prediction
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}

# Views that read other views.
_DEPENDS = {"edges": ["nodes"], "epochs": ["metrics"]}


def _needed(sql: str) -> list[str]:
    found: list[str] = []

    def visit(name: str) -> None:
        for dep in _DEPENDS.get(name, []):
            visit(dep)
        if name not in found:
            found.append(name)

    for name in VIEW_SQL:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    return found


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it references, as CTEs."""
    names = _needed(sql)
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in names)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
