from pyspark.sql import functions as F

from assaykit.functions.text import clean_text_key, fixed, strip_text
from assaykit.operators import text as T

INPUT_SCHEMA = ("doc_id long, input_text string, canonical string, fixed string, canonical_fixed string, "
                "repair_error string, repair_explanation string, repair_confidence double, prediction double")


def test_resolution_ladder(spark):
    rows = [(1, "   ", None, None, None, None, "e", 0.5, 5.0),
            (2, " CCO\n", "CCO", None, None, None, "e", 0.5, 5.0),
            (3, "bad", None, None, None, "timeout", "e", 0.5, 5.0),
            (4, "bad", None, None, None, None, "no idea", 0.1, 5.0),
            (5, "bad", None, "C(", None, None, "tried", 0.2, 5.0),
            (6, "bad", None, "CC", "CC", None, "fixed ring", 0.9, 5.0)]
    df = spark.createDataFrame(rows, INPUT_SCHEMA)
    got = {r.doc_id: r for r in T.resolve_inputs(df).collect()}
    assert got[1].status == "blank" and got[1].error == T.ERR_EMPTY and got[1].input_smiles == ""
    assert got[2].prediction_smiles == "CCO" and got[2].input_smiles == "CCO" and not got[2].was_fixed
    assert got[3].error == T.ERR_REPAIR_FAILED + "timeout"
    assert got[4].error == T.ERR_NO_FIX and got[4].resolved_explanation == "no idea"
    assert got[5].error == T.ERR_BAD_FIX and got[5].llm_fixed_smiles == "C("
    assert got[6].was_fixed and got[6].prediction_smiles == "CC" and got[6].error is None


def test_strip_matches_python(spark):
    samples = ["  a b  ", " x　", "\t\n y \x0b", "​z", "", "\x1cq\x85"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.k for r in df.select(strip_text("s").alias("k")).collect()]
    assert got == [s.strip() for s in samples]
    keys = [r.k for r in df.select(clean_text_key("s").alias("k")).collect()]
    assert keys == [s.strip() or None for s in samples]


def test_transcript_window(spark):
    msgs = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(10)] + [(2, 0, "user", "hi")]
    df = spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.transcript for r in T.recent_transcript(df, 3).collect()}
    assert got[1] == "assistant: m7\nuser: m8\nassistant: m9"
    assert got[2] == "user: hi"


def test_render_context_format(spark):
    df = spark.createDataFrame(
        [("CCO", None, "CCO", False, None, None, 6.12345, None),
         ("bad", "CC", "CC", True, "ring", 0.875, 4.5, "user: hello")],
        "input_smiles string, llm_fixed_smiles string, prediction_smiles string, was_fixed boolean, "
        "resolved_explanation string, resolved_confidence double, prediction double, transcript string")
    a, b = [r.prompt for r in T.render_context(df, question=None).collect()]
    assert "- LLM proposed fixed SMILES: None" in a and "- SMILES repair confidence: None" in a
    assert "- Predicted pIC: 6.1235" in a or "- Predicted pIC: 6.1234" in a
    assert a.endswith("Recent chat history:\n" + T.NO_HISTORY)
    assert "- Input was LLM-repaired before prediction: yes" in b and "- SMILES repair confidence: 0.88" in b


def test_fixed_null(spark):
    df = spark.createDataFrame([(None,), (1.0,)], "x double")
    assert [r.f for r in df.select(fixed("x", 2).alias("f")).collect()] == ["None", "1.00"]


def test_fixed_rounds_the_binary_value(spark):
    df = spark.createDataFrame([(0.125, 6.03125), (1.005, 1.00005), (-0.375, 1234567.5), (2.675, float("nan"))],
                               "a double, b double")
    got = [tuple(r) for r in df.select(fixed("a", 2), fixed("b", 4)).collect()]
    assert got == [(f"{a:.2f}", f"{b:.4f}") for a, b in ((0.125, 6.03125), (1.005, 1.00005), (-0.375, 1234567.5), (2.675, float("nan")))]


def test_null_input_is_blank(spark):
    df = spark.createDataFrame([(1, None, "C"), (2, " ", "C")], "doc_id long, input_text string, canonical string")
    for c in ("fixed", "canonical_fixed", "repair_error", "repair_explanation"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    rows = T.resolve_inputs(df.withColumn("repair_confidence", F.lit(0.5))).collect()
    assert all((r.status, r.was_fixed, r.prediction_smiles, r.error) == ("blank", False, None, T.ERR_EMPTY) for r in rows)


def test_predict_with_retry(spark):
    rows = [  # doc_id, prediction_smiles, was_fixed, error, canonical_fixed, repair_error
        (1, "CCO", False, None, "CC", None),        # works
        (2, None, False, "blank", "CC", None),      # the ladder ended with an error: stays
        (3, "XX", False, None, "CC", None),         # fails, repaired, works
        (4, "XX", True, None, "CC", None),          # was repaired before: no second repair
        (5, "XX", False, None, "XX", None),         # fails again after the repair
        (6, "XX", False, None, "CC", "down"),       # the repair failed
        (7, "XX", False, None, None, None),         # no proposal
    ]
    df = spark.createDataFrame(rows, "doc_id long, prediction_smiles string, was_fixed boolean, error string, "
                                     "canonical_fixed string, repair_error string").withColumns({
        "repair_explanation": F.lit("why"), "resolved_explanation": F.lit(None).cast("string")})

    def predict(d, structure, out, failure):
        return d.withColumns({out: F.when(F.col(structure) != "XX", F.length(structure).cast("double")),
                              failure: F.when(F.col(structure) == "XX", F.lit("cannot"))})

    got = {r.doc_id: (r.prediction_smiles, r.prediction, r.was_fixed, r.error, r.resolved_explanation)
           for r in T.predict_with_retry(df, predict).collect()}
    first, second = T.ERR_AFTER_VALIDATION + "cannot", T.ERR_AFTER_REPAIR + "cannot"
    assert got == {1: ("CCO", 3.0, False, None, None), 2: (None, None, False, "blank", None),
                   3: ("CC", 2.0, True, None, "why"), 4: ("XX", None, True, first, None),
                   5: ("XX", None, True, second, "why"), 6: ("XX", None, False, first, None),
                   7: ("XX", None, False, first, None)}
