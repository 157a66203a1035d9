"""op6: held-out accuracy, und, rejection."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from assaykit.llm import lang_id
from assaykit.llm.common import table
from conftest import SF_MID


def _model(spark):
    docs = table(spark, SF_MID, "documents")
    held = lang_id.held_out(F.col("doc_id"))
    return docs, lang_id.fit(docs.where(~held))


def test_held_out_accuracy_and_edges(spark):
    docs, model = _model(spark)
    rows = lang_id.predict(docs.withColumn("held", lang_id.held_out(F.col("doc_id"))), model).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.002 * len(rows)
    assert len(model.langs) == lang_id.CENTROIDS * 4

    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 ... !?", "c"), (4, "the", "d"), (5, "the", "d"),
                                 (None, "Это совсем другой язык, которого никто не учил здесь никогда раньше" * 4, "e"),
                                 (7, "the of and " * 40_000, "f")], "doc_id long, text string, SCORE string")
    got = lang_id.predict(odd, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    by = {r.text: r for r in got.collect()}
    assert got.count() == 7
    assert all((by[t].lang_pred, by[t].score, by[t].rejected) == ("und", 0.0, True) for t in (None, "", "123 ... !?"))
    assert by["the of and " * 40_000].lang_pred == "en"
    foreign = next(r for t, r in by.items() if t and t[0] == "Э")
    assert foreign.rejected and foreign.lang_pred in model.langs
    assert lang_id.predict(odd.where("false"), model).count() == 0


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert lang_id.fit(df) is None
    assert [r.lang_pred for r in lang_id.predict(df, None).collect()] == ["und"]
    kept = lang_id.keep_known(df.where("false"))
    assert kept.columns == df.columns and kept.count() == 0


def test_prediction_does_not_read_labels(spark):
    docs, model = _model(spark)
    small = docs.limit(20)
    a = {r.doc_id: r.lang_pred for r in lang_id.predict(small, model).collect()}
    b = {r.doc_id: r.lang_pred for r in lang_id.predict(small.withColumn("lang", F.lit("zz")), model).collect()}
    assert a == b


def test_slices_and_late_planes_change_no_feature(monkeypatch):
    texts = ["", " ", "a", "Ab  c1d\n\nÉ日本 ß.", "x" * 50 + " y" * 50, "\U00030001 and \U00031360\U000323AF", "1 2 3"]
    whole = [lang_id.features(t) for t in texts]
    assert [n for _, n in whole] == [sum(c.isalpha() for c in t) for t in texts]
    for size in (1, 2, 3, 10):
        monkeypatch.setattr(lang_id, "SLICE", size)
        for t, (counts, letters) in zip(texts, whole):
            got = lang_id.features(t)
            assert got[1] == letters and (got[0] == counts).all()


def test_cosines_against_plain_numpy(spark):
    docs = table(spark, SF_MID, "documents").select("doc_id", "text", "lang")
    model = lang_id.fit(docs.where(~lang_id.held_out(docs.doc_id)))
    rows = {r.doc_id: r for r in lang_id.predict(docs.select("doc_id", "text").limit(300), model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in rows.items():
        counts, letters = lang_id.features(texts[i] or "")
        if not letters:
            assert r.lang_pred == "und"
            continue
        v = np.log1p(counts.astype(float)) * model.weights
        cosines = [float(v @ c / np.linalg.norm(v)) for c in model.centroids.astype(float)]
        best = int(np.argmax(cosines))
        assert abs(r.score - max(0.0, min(1.0, cosines[best]))) < 1e-4
        assert r.lang_pred == model.langs[best] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-5
