"""Registered queries: input resolution, transcripts and rendered prediction contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.functions.text import STRIP_CHARS, clean_text_key
from assaykit.operators import text as T
from assaykit.plans.catalog import register
from assaykit.sources import fixtures as fx



_STRIP_CHARS_SQL = " || ".join(f"chr({ord(c)})" for c in STRIP_CHARS)


def _strip_sql(x: str) -> str:
    return f"trim({x}, {_STRIP_CHARS_SQL})"


def _transcript_sql(n: int) -> str:
    return f"""
tr AS (SELECT conv_id, CASE WHEN coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn), '') = ''
         THEN '{T.NO_HISTORY}' ELSE string_agg(role || ': ' || text, chr(10) ORDER BY turn) END AS transcript
       FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM messages) r
       WHERE rn <= {n} GROUP BY conv_id)"""


@register("recent_transcript", f"WITH {_transcript_sql(8).strip()} SELECT * FROM tr")
def q_recent_transcript(spark, base):
    return T.recent_transcript(fx.messages(spark, base), 8)


@register("recent_transcript_3", f"WITH {_transcript_sql(3).strip()} SELECT * FROM tr")
def q_recent_transcript_3(spark, base):
    return T.recent_transcript(fx.messages(spark, base), 3)


_RESOLVE_SQL = f"""
st AS (SELECT *, coalesce({_strip_sql('input_text')}, '') AS s FROM inputs),
lad AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN canonical IS NOT NULL THEN 'valid'
          WHEN repair_error IS NOT NULL THEN 'repair_failed' WHEN fixed IS NULL THEN 'no_fix'
          WHEN canonical_fixed IS NULL THEN 'invalid_fix' ELSE 'repaired' END AS status FROM st),
res AS (SELECT doc_id, s AS input_smiles,
  CASE status WHEN 'valid' THEN canonical WHEN 'repaired' THEN canonical_fixed END AS prediction_smiles,
  status = 'repaired' AS was_fixed,
  CASE WHEN status IN ('invalid_fix', 'repaired') THEN fixed END AS llm_fixed_smiles,
  CASE WHEN status IN ('no_fix', 'invalid_fix', 'repaired') THEN repair_explanation END AS resolved_explanation,
  CASE WHEN status IN ('no_fix', 'invalid_fix', 'repaired') THEN repair_confidence END AS resolved_confidence,
  CASE status WHEN 'blank' THEN '{T.ERR_EMPTY}' WHEN 'repair_failed' THEN '{T.ERR_REPAIR_FAILED}' || repair_error
    WHEN 'no_fix' THEN '{T.ERR_NO_FIX}' WHEN 'invalid_fix' THEN '{T.ERR_BAD_FIX}' END AS error,
  status, prediction FROM lad)"""

_RESOLVED_COLS = ("doc_id", "input_smiles", "prediction_smiles", "was_fixed", "llm_fixed_smiles",
                  "resolved_explanation", "resolved_confidence", "error", "status")


@register("resolve_inputs", f"WITH {_RESOLVE_SQL.strip()} SELECT {', '.join(_RESOLVED_COLS)} FROM res")
def q_resolve_inputs(spark, base):
    return T.resolve_inputs(fx.inputs(spark, base)).select(*_RESOLVED_COLS)


@register("render_context", f"""
WITH {_RESOLVE_SQL.strip()},
{_transcript_sql(8).strip()}
SELECT r.doc_id, concat_ws(chr(10),
  'Prediction context:',
  '- Original input SMILES: ' || coalesce(r.input_smiles, 'None'),
  '- LLM proposed fixed SMILES: ' || CASE WHEN r.llm_fixed_smiles IS NULL OR r.llm_fixed_smiles = '' THEN 'None'
                                         ELSE r.llm_fixed_smiles END,
  '- SMILES used for prediction: ' || coalesce(r.prediction_smiles, 'None'),
  '- Input was LLM-repaired before prediction: ' || CASE WHEN r.was_fixed THEN 'yes' ELSE 'no' END,
  '- SMILES repair explanation: ' || CASE WHEN r.resolved_explanation IS NULL OR r.resolved_explanation = ''
                                         THEN '{T.NO_REPAIR_NOTE}' ELSE r.resolved_explanation END,
  '- SMILES repair confidence: ' || coalesce(printf('%.2f', r.resolved_confidence), 'None'),
  '- Predicted pIC: ' || coalesce(printf('%.4f', r.prediction), 'None'),
  '- Prediction model checkpoint: {T.DEFAULT_MODEL_PATH}',
  '',
  'Recent chat history:',
  CASE WHEN t.transcript IS NULL OR t.transcript = '' THEN '{T.NO_HISTORY}' ELSE t.transcript END,
  '',
  'User question:',
  'Why ' || r.status || '?') AS prompt
FROM res r LEFT JOIN tr t ON t.conv_id = r.doc_id
WHERE r.prediction_smiles IS NOT NULL""")
def q_render_context(spark, base):
    res = T.resolve_inputs(fx.inputs(spark, base)).where(F.col("prediction_smiles").isNotNull())
    tr = T.recent_transcript(fx.messages(spark, base), 8)
    j = res.join(tr, res.doc_id == tr.conv_id, "left")
    asked = j.withColumn("question", F.concat(F.lit("Why "), F.col("status"), F.lit("?")))
    return T.render_context(asked, question="question").select("doc_id", "prompt")


# A predictor that SQL can express: structures that end in an odd digit or in "e" can't be scored.
_FAILS = "[13579e]$"
_MESSAGE = "no score for "


def _score(df, structure, out, failure):
    s = F.col(structure)
    bad = s.rlike(_FAILS)
    return df.withColumns({out: F.when(s.isNotNull() & ~bad, F.length(s) + F.lit(0.5)),
                           failure: F.when(s.isNotNull() & bad, F.concat(F.lit(_MESSAGE), s))})


@register("predict_with_retry", f"""
WITH {_RESOLVE_SQL.strip()},
j AS (SELECT res.*, i.canonical_fixed, i.repair_error, i.repair_explanation,
       regexp_matches(coalesce(prediction_smiles, ''), '{_FAILS}') AS failed
     FROM res JOIN inputs i USING (doc_id)),
a AS (SELECT *, failed AND NOT was_fixed AND repair_error IS NULL AND canonical_fixed IS NOT NULL AS again FROM j),
b AS (SELECT *, again AND regexp_matches(canonical_fixed, '{_FAILS}') AS failed_again FROM a)
SELECT doc_id, CASE WHEN again THEN canonical_fixed ELSE prediction_smiles END AS prediction_smiles,
  CASE WHEN again THEN CASE WHEN NOT failed_again THEN length(canonical_fixed) + 0.5::DOUBLE END
       WHEN prediction_smiles IS NOT NULL AND NOT failed THEN length(prediction_smiles) + 0.5::DOUBLE END AS prediction,
  again OR was_fixed AS was_fixed,
  CASE WHEN again THEN repair_explanation ELSE resolved_explanation END AS resolved_explanation,
  CASE WHEN again THEN CASE WHEN failed_again THEN '{T.ERR_AFTER_REPAIR}{_MESSAGE}' || canonical_fixed END
       WHEN failed THEN '{T.ERR_AFTER_VALIDATION}{_MESSAGE}' || prediction_smiles
       WHEN prediction_smiles IS NULL THEN error END AS error
FROM b""")
def q_predict_with_retry(spark, base):
    return T.predict_with_retry(T.resolve_inputs(fx.inputs(spark, base)), _score).select(
        "doc_id", "prediction_smiles", "prediction", "was_fixed", "resolved_explanation", "error")


@register("clean_text_key", f"""
SELECT doc_id, CASE WHEN {_strip_sql('input_text')} = '' THEN NULL
                    ELSE {_strip_sql('input_text')} END AS text_key FROM inputs""")
def q_clean_text_key(spark, base):
    return fx.inputs(spark, base).select("doc_id", clean_text_key("input_text").alias("text_key"))
