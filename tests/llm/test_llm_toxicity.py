"""op5: accuracy on labelled documents that were held out, and edge cases."""

import numpy as np
from pyspark.sql import functions as F

from assaykit.llm import toxicity
from assaykit.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_edges(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    labels = table(spark, SF, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    odd = spark.createDataFrame([(0, None, 1), (0, 1, 1), (None, 0, 0), (10**9, 1, 1)], labels.schema)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    chain = toxicity.fit_chain(docs, labels.where(~held).unionByName(odd), ["low_quality", "toxic"])
    rows = toxicity.predict(docs, chain).join(labels.where(held), "doc_id").collect()
    assert len(rows) > 100
    assert sum(r.is_toxic == (r.toxic == 1) for r in rows) / len(rows) > 0.94
    assert sum(r.is_toxic for r in rows if r.toxic == 0) <= 0.02 * len(rows)
    assert sum(r.is_low_quality == (r.low_quality == 1) for r in rows) / len(rows) > 0.75

    extra = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "trash " * 60_000, "c"), (2, "x", "d"), (2, "x", "d")],
                                  "doc_id long, text string, P_TOXIC string")
    got = toxicity.predict(extra, chain)
    assert got.columns == ["doc_id", "text", "p_low_quality", "p_toxic", "is_low_quality", "is_toxic"]
    by = got.collect()
    assert len(by) == 5 and all(0 <= r.p_toxic <= 1 for r in by)
    assert {r.p_toxic for r in by if not r.text} == {next(r.p_toxic for r in by if r.text is None)}
    assert toxicity.predict(extra.where("false"), chain).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.fit_chain(docs, labels, ["toxic"])
    r = toxicity.predict(docs, chain).first()
    assert r.p_toxic == 0.0 and not r.is_toxic


def test_chain_against_plain_numpy(spark):
    """Each probability from the words, the coefficients and the probabilities before it."""
    docs = spark.range(240).selectExpr("id AS doc_id", """concat(if(id % 3 = 0, 'vile trash ', 'kind words '), if(id % 2 = 0, 'poor stuff ', 'fine work '),
        'of number ', cast(id % 7 AS string), if(id % 3 = 0 AND id % 5 > 0, ' awful', '')) AS text""")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 AS int) AS low", "cast(doc_id % 3 = 0 AS int) AS toxic")
    chain = toxicity.fit_chain(docs, labels, ["low", "toxic"])
    index = {w: i for i, w in enumerate(chain.words.vocabulary)}
    words = {r.doc_id: r.w for r in docs.select("doc_id", toxicity._words(F.col("text")).alias("w")).collect()}
    for r in toxicity.predict(docs, chain).collect():
        x = np.zeros(len(index))
        x[[index[w] for w in words[r.doc_id] if w in index]] = 1
        before = []
        for name, model, limit in zip(chain.categories, chain.models, chain.thresholds):
            weights = model.coefficients.toArray()
            assert len(weights) == len(x) + len(before)
            p = 1 / (1 + np.exp(-(weights @ np.concatenate((x, before)) + model.intercept)))
            assert abs(r[f"p_{name}"] - p) < 1e-9 and r[f"is_{name}"] == (p >= limit)
            before.append(p)
        assert r.is_toxic == (r.doc_id % 3 == 0) and r.is_low == (r.doc_id % 2 == 0)
