"""Input resolution, transcripts and prediction-context rendering.

The reference resolves one structure string at a time inside an app; here
the same ladder is one ``when`` chain over a table whose columns carry the
outcome of each step (parse, repair proposal, parse of the proposal, repair
failure), so millions of inputs resolve in a single narrow projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.text import fixed, or_default, strip_text, yes_no

# Fixed values that must equal the reference's messages and defaults.
ERR_EMPTY = "Enter a SMILES string."
ERR_REPAIR_FAILED = "Invalid SMILES. The LLM repair agent failed: "
ERR_NO_FIX = "Invalid SMILES. The LLM repair agent did not return a fix."
ERR_BAD_FIX = "The LLM repair agent returned an invalid SMILES string."
ERR_AFTER_VALIDATION = "Prediction failed after SMILES validation: "
ERR_AFTER_REPAIR = "Prediction failed after SMILES repair: "
NO_REPAIR_NOTE = "No LLM repair was used."
NO_HISTORY = "No previous chat messages."
HISTORY_WINDOW = 8
DEFAULT_MODEL_PATH = "artifacts/gcn_best.pt"


def resolve_inputs(df: DataFrame, text: str = "input_text", canonical: str = "canonical",
                   fixed_col: str = "fixed", canonical_fixed: str = "canonical_fixed",
                   repair_error: str = "repair_error", explanation: str = "repair_explanation",
                   confidence: str = "repair_confidence") -> DataFrame:
    """Resolution record per input.

    Ladder: blank (or NULL) -> error; parses -> use canonical; repair raised -> error
    with its message; no proposal -> error; proposal does not parse -> error;
    else use the canonical proposal and flag ``was_fixed``. ``status`` names
    the branch taken.
    """
    s = F.coalesce(strip_text(text), F.lit(""))
    blank = s == ""
    ok = ~blank & F.col(canonical).isNotNull()
    failed = ~blank & ~ok & F.col(repair_error).isNotNull()
    no_fix = ~blank & ~ok & ~failed & F.col(fixed_col).isNull()
    bad_fix = ~blank & ~ok & ~failed & ~no_fix & F.col(canonical_fixed).isNull()
    repaired = ~blank & ~ok & ~failed & ~no_fix & ~bad_fix
    null_s = F.lit(None).cast("string")
    null_d = F.lit(None).cast("double")
    has_expl = no_fix | bad_fix | repaired
    return df.select(
        "*",
        s.alias("input_smiles"),
        F.when(ok, F.col(canonical)).when(repaired, F.col(canonical_fixed)).otherwise(null_s)
        .alias("prediction_smiles"),
        repaired.alias("was_fixed"),
        F.when(bad_fix | repaired, F.col(fixed_col)).otherwise(null_s).alias("llm_fixed_smiles"),
        F.when(has_expl, F.col(explanation)).otherwise(null_s).alias("resolved_explanation"),
        F.when(has_expl, F.col(confidence).cast("double")).otherwise(null_d).alias("resolved_confidence"),
        F.when(blank, F.lit(ERR_EMPTY))
        .when(failed, F.concat(F.lit(ERR_REPAIR_FAILED), F.col(repair_error)))
        .when(no_fix, F.lit(ERR_NO_FIX))
        .when(bad_fix, F.lit(ERR_BAD_FIX)).otherwise(null_s).alias("error"),
        F.when(blank, "blank").when(ok, "valid").when(failed, "repair_failed")
        .when(no_fix, "no_fix").when(bad_fix, "invalid_fix").otherwise("repaired").alias("status"),
    )


def recent_transcript(messages: DataFrame, n: int = HISTORY_WINDOW, conv: str = "conv_id",
                      turn: str = "turn", role: str = "role", text: str = "text",
                      out: str = "transcript") -> DataFrame:
    """Last ``n`` turns per conversation as 'role: text' lines, oldest first.

    ``row_number() <= n`` is planned with a group limit before the shuffle, so
    a conversation of any length contributes at most ``n`` rows per task.
    """
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    last = messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    lines = last.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(
        F.col(turn).alias("t"), F.concat_ws(": ", F.col(role), F.col(text)).alias("line")))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return lines.select(conv, or_default(joined, NO_HISTORY).alias(out))


def render_context(df: DataFrame, transcript: str = "transcript", question: str | None = None,
                   model_path: str = DEFAULT_MODEL_PATH, out: str = "prompt") -> DataFrame:
    """The prediction context as the text block the chat model receives.

    Expects the resolution columns (input_smiles, llm_fixed_smiles,
    prediction_smiles, was_fixed, resolved_explanation, resolved_confidence)
    and a ``prediction`` column. Formatting: 4 decimals for the prediction,
    2 for the confidence, 'None' for missing values, yes/no for the flag.
    """
    lines = F.concat_ws(
        "\n",
        F.lit("Prediction context:"),
        F.concat(F.lit("- Original input SMILES: "), F.coalesce(F.col("input_smiles"), F.lit("None"))),
        F.concat(F.lit("- LLM proposed fixed SMILES: "), or_default("llm_fixed_smiles", "None")),
        F.concat(F.lit("- SMILES used for prediction: "), F.coalesce(F.col("prediction_smiles"), F.lit("None"))),
        F.concat(F.lit("- Input was LLM-repaired before prediction: "), yes_no("was_fixed")),
        F.concat(F.lit("- SMILES repair explanation: "), or_default("resolved_explanation", NO_REPAIR_NOTE)),
        F.concat(F.lit("- SMILES repair confidence: "), fixed("resolved_confidence", 2)),
        F.concat(F.lit("- Predicted pIC: "), fixed("prediction", 4)),
        F.concat(F.lit("- Prediction model checkpoint: "), F.lit(model_path)),
        F.lit(""),
        F.lit("Recent chat history:"),
        or_default(transcript, NO_HISTORY),
    )
    if question is not None:
        lines = F.concat_ws("\n", lines, F.lit(""), F.lit("User question:"), F.col(question))
    return df.withColumn(out, lines)


def predict_with_retry(resolved: DataFrame, predict: Callable[[DataFrame, str, str, str], DataFrame],
                       canonical_fixed: str = "canonical_fixed", repair_error: str = "repair_error",
                       explanation: str = "repair_explanation") -> DataFrame:
    """Predict for resolved inputs; a failed one gets one repair and one more prediction (R2).

    ``predict(df, structure, out, failure)`` adds two columns for the structure
    column it is given: the prediction, and the failure's message (NULL when it
    went well). Rows stay where they are: no join, no second scan.

    Only rows whose own structure failed are repaired: not those that the ladder
    ended with an error (kept as they are), nor those that were repaired before.
    Without a repair (it failed, or its proposal doesn't parse) the row keeps the
    first failure's message; with one it becomes the repaired row, with its
    prediction or the second failure's message.
    """
    df = predict(resolved, "prediction_smiles", "_first", "_failure")
    ready = F.col("prediction_smiles").isNotNull()
    failed = ready & F.col("_failure").isNotNull()
    again = (failed & ~F.coalesce(F.col("was_fixed"), F.lit(False)) & F.col(repair_error).isNull()
             & F.col(canonical_fixed).isNotNull())
    df = df.withColumn("_again", again).withColumn("_retry", F.when(F.col("_again"), F.col(canonical_fixed)))
    df = predict(df, "_retry", "_second", "_second_failure")
    error = (F.when(F.col("_again") & F.col("_second_failure").isNotNull(),
                    F.concat(F.lit(ERR_AFTER_REPAIR), F.col("_second_failure")))
             .when(failed & ~F.col("_again"), F.concat(F.lit(ERR_AFTER_VALIDATION), F.col("_failure")))
             .when(~ready, F.col("error")))
    prediction = (F.when(F.col("_again"), F.when(F.col("_second_failure").isNull(), F.col("_second")))
                  .when(ready & F.col("_failure").isNull(), F.col("_first")))
    return df.withColumns({
        "prediction": prediction, "error": error,
        "prediction_smiles": F.coalesce("_retry", "prediction_smiles"),
        "was_fixed": F.col("_again") | F.coalesce(F.col("was_fixed"), F.lit(False)),
        "resolved_explanation": F.when(F.col("_again"), F.col(explanation)).otherwise(F.col("resolved_explanation")),
    }).drop("_first", "_failure", "_again", "_retry", "_second", "_second_failure")
