"""Language identification by nearest centroids.

A text is the bag of its hashed letter n-grams (1 to 3), as a normalised TF-IDF
vector. Every language has several centroids, found by spherical k-means over a
bounded sample of labelled texts. A text gets the language of the centroid with
the highest cosine, and is rejected when it is too far from it: the bound
depends on the number of letters, since short texts lie farther out.

Defined results: null texts and texts without a letter are ``und``, score 0,
rejected; ties go to the language that sorts first; without labelled texts
every document is ``und``; all input rows and columns stay.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import append_columns, col, free_prefix, prefixed, small_batches, texts

#: Bound of the fit: about so many labelled texts of each language are taken, by a hash of their id.
SAMPLE_PER_LANG = 400
CENTROIDS = 3
BUCKETS = 1 << 13
#: A text is rejected below this share of the lowest cosines (their 1 % quantile) of texts of its length.
REJECT_SHARE = 0.5
#: Numbers of letters that part the classes of length.
LENGTHS = (32, 128, 512, 2048)

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("rejected", T.BooleanType())])

#: Characters of a text that are counted at once.
SLICE = 1 << 18

_letters: list[np.ndarray] = []


def _fold(codes: np.ndarray) -> np.ndarray:
    """Lower-case letters as they are, all else as blanks."""
    if not _letters:
        low = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(len(low)):
            s = chr(c)
            if s.isalpha():
                low[c] = ord(s.lower()[0])
        _letters.append(low)
    return _letters[0][codes]


def _buckets(a: np.ndarray, new: int) -> np.ndarray:
    """Counts by bucket of the n-grams that end in the last ``new`` characters."""
    one = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = a.astype(np.uint64)
    two = (one[:-1] ^ (a[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
    three = (two[:-1] ^ (a[2:] * np.uint64(0x27D4EB2F165667C5))) * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    grams = np.concatenate([x[max(0, len(x) - new):] for x in (one, two, three)])
    return np.bincount((grams >> shift).astype(np.int64), minlength=BUCKETS)


def features(text: str) -> tuple[np.ndarray, int]:
    """Counts of the n-grams by bucket, and the number of letters; slice by slice, with the last two characters carried."""
    tail = np.array([32], np.uint32)
    counts, letters = _buckets(tail, 1), 0
    for at in range(0, len(text), SLICE):
        part = text[at:at + SLICE] + (" " if at + SLICE >= len(text) else "")
        a = _fold(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4"))
        blank = a == 32
        letters += len(a) - int(blank.sum())
        keep = ~blank
        keep[1:] |= ~blank[:-1]  # one blank of a run
        keep[0] |= tail[-1] != 32
        a = np.concatenate((tail, a[keep]))
        counts += _buckets(a, len(a) - len(tail))
        tail = a[-2:]
    return (counts, letters) if letters else (np.zeros(BUCKETS, np.int64), 0)


@dataclass
class Model:
    langs: list[str]       # of each centroid
    weights: np.ndarray    # inverse document frequencies
    centroids: np.ndarray  # unit rows
    floors: np.ndarray     # lowest accepted cosine of each class of length

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts.astype(np.float32)) * self.weights
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def held_out(doc_id: Column) -> Column:
    """Documents kept for measuring: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by cosine; starts are the rows farthest from those before, so nothing is random."""
    at = [int(np.argmin(x @ x.mean(axis=0)))]
    while len(at) < min(k, len(x)):
        at.append(int(np.argmin((x @ x[at].T).max(axis=1))))
    c = x[at]
    for _ in range(20):
        near = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-5):
            break
        c = new
    return c


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id",
        per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS) -> Model | None:
    """Fit on about ``per_lang`` texts of each language (all, if fewer), chosen by a hash of ``key``.

    Only the sample's sparse counts come to the driver: at most about 1.3 x
    ``per_lang`` rows a language.
    """
    small_batches(labelled.sparkSession)
    known = labelled.where(col(lang).isNotNull() & col(text).isNotNull())
    sizes = known.groupBy(col(lang).alias("lang")).count()  # one row per language
    place = F.pmod(F.xxhash64(col(key), F.lit(17)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = known.select(col(lang).alias("lang"), col(text).alias("body"), place.alias("place")).join(
        F.broadcast(sizes), "lang").where(F.col("place") < F.lit(float(per_lang)) / F.col("count")).select("lang", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, *features(t)) for lang, t in zip(batch.column(0).to_pylist(), texts(batch, "body"))]
            rows = [(lang, np.flatnonzero(c), c, n) for lang, c, n in rows if n]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([r[0] for r in rows], pa.string()),
                "at": pa.array([r[1].astype("<u2").tobytes() for r in rows], pa.binary()),
                "counts": pa.array([r[2][r[1]].astype("<u4").tobytes() for r in rows], pa.binary()),
                "letters": pa.array([r[3] for r in rows], pa.int64())})

    rows = sorted(sample.mapInArrow(run, "lang string, at binary, counts binary, letters long").collect())
    if not rows:
        return None

    def dense(some: list) -> np.ndarray:
        out = np.zeros((len(some), BUCKETS), np.float32)
        for i, r in enumerate(some):
            out[i, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.counts, "<u4")
        return out

    seen = np.zeros(BUCKETS)
    for r in rows:
        seen[np.frombuffer(r.at, "<u2")] += 1
    model = Model([], (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32), np.zeros((0, BUCKETS)), np.zeros(0))
    parts, cosines, letters = [], [], []
    for name in sorted({r.lang for r in rows}):
        own = [r for r in rows if r.lang == name]
        x = model.vectors(dense(own))
        c = _k_means(x, centroids)
        model.langs += [name] * len(c)
        parts.append(c)
        cosines.append((x @ c.T).max(axis=1))
        letters += [r.letters for r in own]
    model.centroids = np.concatenate(parts).astype(np.float32)
    cosines, size = np.concatenate(cosines), np.searchsorted(LENGTHS, letters, side="right")
    low = cosines.min()
    model.floors = REJECT_SHARE * np.array([
        np.quantile(cosines[size == k], 0.01) if (size == k).sum() >= 20 else low for k in range(len(LENGTHS) + 1)])
    return model


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected.

    The model is one row of floats per centroid (about 100 KB a language).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(batch: pa.RecordBatch) -> list:
            rows, out = texts(batch, text), []
            for at in range(0, len(rows), 128):
                got = [features(t) for t in rows[at:at + 128]]
                letters = np.array([n for _, n in got])
                if m is None:
                    out += [("und", 0.0, True)] * len(got)
                    continue
                cos = m.vectors(np.stack([c for c, _ in got])) @ m.centroids.T
                best = cos.argmax(axis=1)
                score = np.clip(cos[np.arange(len(best)), best], 0, 1).astype(float)
                far = score < m.floors[np.searchsorted(LENGTHS, letters, side="right")]
                out += [(m.langs[b], float(s), bool(f)) if n else ("und", 0.0, True)
                        for b, s, f, n in zip(best, score, far, letters)]
            return [list(x) for x in zip(*out)]

        return work

    return append_columns(docs, prefixed(FIELDS, prefix), make)


def keep_known(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Documents that aren't rejected by a model fitted on the labelled, not held-out ones; columns as before."""
    model = fit(docs.where(~held_out(col(key)) & col(key).isNotNull()), text=text, lang=lang, key=key)
    p = free_prefix(docs, "lang")
    found = predict(docs, model, text=text, prefix=p)
    return found.where(~F.col(p + "rejected")).select(*[col(c) for c in docs.columns])
