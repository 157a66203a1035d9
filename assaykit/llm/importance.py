"""Importance resampling towards a target distribution, with bit-sliced exact weights.

Features are runs of one or two words, hashed to buckets. The gain of a bucket
is the logarithm of its share in the target against its share in the corpus,
smoothed, as a whole number of thousandths. A document's bucket counts become
bit planes of one bit per bucket, and so do the gains (two's complement): the
sum of count times gain over all buckets is the sum, over pairs of planes, of
the number of bits both have, times a power of two. No rounding takes part.
The draw adds Gumbel noise hashed from the seed and the key and keeps the
highest scores, which samples without replacement by weight.

Defined results: a null text has no words; a document without features has
weight 0 and may have a score but, having too few words, is never drawn; ties
go to the smaller key, null keys last; repeated rows are documents of their
own; an empty table gives an empty result, an empty target smoothed gains.
Other columns pass; those named as a new one are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import append_columns, col, free_prefix, small_batches, without
from assaykit.operators.ranking import global_index

N_BUCKETS = 10_000
#: Bytes of a text whose words are listed at once.
SLICE = 1 << 20
#: Documents whose counts are sliced into planes together.
ROWS = 64

FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "gain_sum", "weight")])

#: Bytes of words (digits, letters, all beyond ASCII), A-Z lowered; every other byte is a blank.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def slices(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about SLICE bytes, cut where a word ends."""
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + SLICE) if at + SLICE < len(raw) else None
        end = gap.start() if gap else len(raw)
        yield raw[at:end]
        at = end


def hashed(raw: bytes, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their features) per slice of a text; a pair across a cut belongs to the later slice."""
    last = None
    for part in slices(raw):
        words = part.translate(_WORD_BYTES).split()
        if not words:
            continue
        one = list(map(crc32, words))
        lead = list(map(crc32, repeat(b" "), one))
        two = list(map(crc32, words[1:], lead))
        if last is not None:
            two.append(crc32(words[0], last))
        last = lead[-1]
        yield len(words), np.array(one + two, np.uint32) % np.uint32(n_buckets)


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def bucket_counts(df: DataFrame, *, text: str = "text", n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. One row per task and bucket is shuffled; the driver gets ``n_buckets`` rows."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for raw in raw_texts(batch, text):
                for _, buckets in hashed(raw, n_buckets):
                    total += np.bincount(buckets, minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    counted = df.select(col(text)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of target share over source share by bucket, one added to every bucket, rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def bit_planes(values: np.ndarray, n_planes: int) -> np.ndarray:
    """Planes by value bit of rows of whole numbers, 64 bits a word: (rows, planes, words). Negatives: two's complement."""
    rows, n = values.shape
    padded = np.zeros((rows, n_planes, -(-n // 64) * 64), np.uint8)
    for i in range(n_planes):
        padded[:, i, :n] = (values >> i) & 1
    return np.packbits(padded, axis=2).view(np.uint64)


def plane_sums(counts: np.ndarray, gain_planes: np.ndarray) -> np.ndarray:
    """Sum of count x gain per row: popcounts of ANDed planes times powers of two; the last gain plane is negative."""
    count_planes = bit_planes(counts, max(1, int(counts.max(initial=0)).bit_length()))
    out = np.zeros(len(counts), np.int64)
    for j, gain in enumerate(gain_planes):
        sign = -1 if j == len(gain_planes) - 1 else 1
        both = np.bitwise_count(count_planes & gain).sum(axis=2, dtype=np.int64)
        out += sign * (both << (np.arange(both.shape[1]) + j)).sum(axis=1)
    return out


def with_weights(df: DataFrame, gain: np.ndarray, *, text: str = "text") -> DataFrame:
    """``df`` with n_words, n_features, gain_sum and weight (the floored mean gain) of each whole text."""
    n_buckets = len(gain)
    width = max(int(gain.max(initial=0)), -int(gain.min(initial=0)) - 1, 0).bit_length() + 1
    gain_planes = bit_planes(gain[None, :], width)[0]

    def make():
        def work(batch: pa.RecordBatch) -> list:
            raws = raw_texts(batch, text)
            n_words, n_features, sums = [], [], []
            for at in range(0, len(raws), ROWS):
                counts = np.zeros((len(raws[at:at + ROWS]), n_buckets), np.int32)
                for row, raw in zip(counts, raws[at:at + ROWS]):
                    n = 0
                    for k, buckets in hashed(raw, n_buckets):
                        n += k
                        row += np.bincount(buckets, minlength=n_buckets).astype(np.int32)
                    n_words.append(n)
                    n_features.append(max(0, 2 * n - 1))
                sums += plane_sums(counts, gain_planes).tolist()
            return [n_words, n_features, sums, [s // n if n else 0 for s, n in zip(sums, n_features)]]

        return work

    return append_columns(df, FIELDS, make)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, hashed from the seed and the key (a null key: from the seed)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(weighted: DataFrame, *, key: str = "doc_id", percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``weighted`` with score and rank: floor(percent * N / 100) of the N documents of at least ``least_words`` words.

    The order is a distributed one (range partitions and their offsets), so
    ``weighted`` is read more than once: give a stored table.
    """
    able = F.col("n_words") >= least_words
    rest = without(weighted, ["score", "rank"])
    kept = free_prefix(rest, "kept")
    scored = rest.select(
        *[col(c).alias(kept + c) for c in rest.columns], (~able).cast("int").alias("_out"),
        (F.col("weight") + noise(col(key), seed)).alias("score"))
    placed = global_index(scored, ["_out", F.col("score").desc(), col(kept + key).asc_nulls_last()], "_place")
    n_drawn = percent * weighted.where(able).count() // 100
    rank = F.when((F.col("_out") == 0) & (F.col("_place") < n_drawn), F.col("_place") + 1)
    return placed.select(*[col(kept + c).alias(c) for c in rest.columns], "score", rank.cast("long").alias("rank"))
