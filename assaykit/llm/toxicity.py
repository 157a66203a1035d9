"""Toxicity categories by a classifier chain.

Categories are predicted in order. Each has a linear model (logistic
regression) over the words of the text and the probabilities of all earlier
categories. For training those probabilities are out of fold: they come from
models that haven't seen the row, as they will be for new texts. The final
models are fitted on all training rows, and each category's threshold is the
one with the best F1 score on its out-of-fold probabilities.

The features are the most frequent words and word stems of the training rows,
present or not, so long texts weigh no more than short ones word for word; stems
carry over to inflected forms that the training rows don't have.

Defined results: a null text has no words and gets the probabilities of an
empty one; labels that are null, or of documents that don't exist, are not
used; a document of several label rows has a category if one of them says so; a
category that only ever is 0 or 1 is predicted as that; all input rows and
columns stay, repeated rows included.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import col, free_prefix
from assaykit.session import stored

#: Bound of the fit: about so many labelled documents are taken, by a hash of their id.
TRAIN_ROWS = 20_000
FOLDS = 2
VOCABULARY, LEAST_ROWS = 16_384, 3  # words and stems, and training rows that one must be in
STEMS = (3, 4, 6)
REGULARISATION, ITERATIONS = 1e-4, 30


@dataclass
class Chain:
    categories: list[str]
    words: CountVectorizerModel
    models: list[LogisticRegressionModel | float] = field(default_factory=list)  # a number: the constant probability
    thresholds: list[float] = field(default_factory=list)


def _words(text: Column) -> Column:
    """Distinct words, and the stems (first letters) of the longer ones, marked by a hyphen."""
    words = F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""))

    def stems(n: int) -> Column:
        return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > n),
                                            lambda w: F.concat(F.substring(w, 1, n), F.lit("-"))))

    return F.concat(words, *[stems(n) for n in STEMS])


def _featured(df: DataFrame, words: CountVectorizerModel, text: Column, tmp: str, out: str) -> DataFrame:
    model = words.copy({words.inputCol: tmp, words.outputCol: out})
    return model.transform(df.withColumn(tmp, _words(text))).drop(tmp)


def _inputs(df: DataFrame, base: str, earlier: list[str], out: str) -> DataFrame:
    return VectorAssembler(inputCols=[base, *earlier], outputCol=out).transform(df) if earlier else df.withColumn(out, F.col(base))


def _probability(df: DataFrame, model: LogisticRegressionModel | float, base: str, earlier: list[str], out: str,
                 tmp: str) -> DataFrame:
    """``df`` with one category's probability."""
    if isinstance(model, float):
        return df.withColumn(out, F.lit(model))
    got = model.copy({model.featuresCol: tmp, model.probabilityCol: tmp + "p", model.rawPredictionCol: "",
                      model.predictionCol: ""}).transform(_inputs(df, base, earlier, tmp))
    return got.withColumn(out, vector_to_array(F.col(tmp + "p"))[1]).drop(tmp, tmp + "p")


def _fit(rows: DataFrame, label: str, earlier: list[str]) -> LogisticRegressionModel | float:
    n, ones = rows.agg(F.count("*"), F.sum(label)).first()
    if not n or ones in (0, n):
        return float(ones / n) if n else 0.0
    data = _inputs(rows, "features", earlier, "inputs").select("inputs", F.col(label).cast("double").alias("label"))
    return LogisticRegression(featuresCol="inputs", regParam=REGULARISATION, standardization=False, maxIter=ITERATIONS).fit(data)


def _best_threshold(rows: DataFrame, label: str, probability: str) -> float:
    """Threshold of the best F1 score, on a grid of 1/100."""
    counts = np.zeros((101, 2))
    for r in rows.groupBy(F.floor(F.col(probability) * 100).cast("int").alias("cell"), F.col(label).alias("y")).count().collect():
        counts[min(100, max(0, r.cell)), int(r.y)] = r["count"]
    above = counts[::-1].cumsum(axis=0)[::-1]
    f1 = 2 * above[:, 1] / np.maximum(above.sum(axis=1) + counts[:, 1].sum(), 1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(np.median(best[best > 0]) / 100) if (best > 0).any() else 0.5


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], *, doc_id: str = "doc_id",
                  text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Words, fold and 0/1 categories of about ``train_rows`` labelled documents at most (all, if fewer)."""
    known = labels.select(col(doc_id).alias("doc_id"), *[col(c).cast("int").alias(c) for c in categories]).where(
        " AND ".join(["doc_id IS NOT NULL", *[f"`{c}` IN (0, 1)" for c in categories]]))
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    share = train_rows / max(1, known.count())
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = known.where(place < share).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(FOLDS)).cast("int"))
    # The sample is bounded (long id, two small numbers a row), so the documents needn't be shuffled.
    texts = docs.select(col(doc_id).alias("doc_id"), col(text).alias("body")).join(F.broadcast(chosen), "doc_id")
    return texts.select(_words(F.col("body")).alias("words"), "fold", *categories)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], **options) -> Chain:
    """Fit the chain in the order of ``categories`` (0/1 columns of ``labels``)."""
    sample = stored(training_rows(docs, labels, categories, **options), "toxicity")
    if sample.isEmpty():
        sample = sample.sparkSession.createDataFrame([([""], 0, *[0 for _ in categories])], sample.schema)
    least = min(LEAST_ROWS, sample.count())
    words = CountVectorizer(inputCol="words", outputCol="features", vocabSize=VOCABULARY, minDF=least, binary=True).fit(sample)
    rows = stored(words.transform(sample).select("features", "fold", *categories).repartition(4), "toxicity")
    chain = Chain(categories, words)
    for k, c in enumerate(categories):
        earlier = [f"oof_{x}" for x in categories[:k]]
        parts = []
        for f in range(FOLDS):
            model = _fit(rows.where(F.col("fold") != f), c, earlier)
            parts.append(_probability(rows.where(F.col("fold") == f), model, "features", earlier, f"oof_{c}", "tmp"))
        chain.models.append(_fit(rows, c, earlier))
        held = parts[0]
        for p in parts[1:]:
            held = held.unionByName(p)
        rows = stored(held, "toxicity")
        chain.thresholds.append(_best_threshold(rows, c, f"oof_{c}"))
    return chain


def predict(docs: DataFrame, chain: Chain, *, text: str = "text") -> DataFrame:
    """``docs`` with p_<category> and is_<category> for each category of the chain."""
    p = free_prefix(docs, "chain")
    out = _featured(docs, chain.words, col(text), p + "words", p + "features")
    earlier: list[str] = []
    for c, model in zip(chain.categories, chain.models):
        out = _probability(out, model, p + "features", earlier, p + c, p + "tmp")
        earlier.append(p + c)
    new = {f"p_{c}".lower() for c in chain.categories} | {f"is_{c}".lower() for c in chain.categories}
    return out.select(*[col(c) for c in docs.columns if c.lower() not in new],
                      *[F.col(p + c).alias(f"p_{c}") for c in chain.categories],
                      *[(F.col(p + c) >= F.lit(t)).alias(f"is_{c}") for c, t in zip(chain.categories, chain.thresholds)])
