"""op13 against a plain version with dictionaries and whole numbers."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np

from assaykit.llm import importance as I
from assaykit.llm.common import table
from assaykit.llm.queries import QUERIES
from conftest import SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [crc32(x.encode()) % 10000 for x in [*w, *map(" ".join, zip(w, w[1:]))]]


def brute(docs, target):
    per = {i: features(t) for i, t in docs}
    s, t = Counter(b for _, f in per.values() for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in s}
    rows = []
    for i, (n, f) in per.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k for k, r in enumerate(able[:25 * len(able) // 100], 1)}
    return sorted((*r[:4], rank.get(r[0])) for r in rows)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    target = [r.text for r in table(spark, SF_SMALL, "benchmark").collect()]
    got = QUERIES["op13_importance_resampling"](spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute(docs, target)
    assert sorted(map(tuple, got.collect())) == want and sum(r[4] is not None for r in want) > 10


def test_planes_are_exact():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 1000):
        counts = rng.integers(0, 5, (7, n)).astype(np.int32)
        counts[0, 0] = 2 ** 30
        gain = rng.integers(-30000, 30000, n)
        width = int(max(gain.max(), -gain.min() - 1, 0)).bit_length() + 1
        assert I.plane_sums(counts, I.bit_planes(gain[None, :], width)[0]).tolist() == (counts.astype(object) @ gain).tolist()


def test_slices_lose_no_feature(monkeypatch):
    text = "Ärger MIT 3 Wörtern, und-so_weiter... " * 50 + "x" * 400 + " ende"
    want = features(text)
    for size in (1, 7, 64, 10_000):
        monkeypatch.setattr(I, "SLICE", size)
        parts = list(I.hashed(text.encode(), 10000))
        assert sum(n for n, _ in parts) == want[0]
        assert Counter(int(b) for _, x in parts for b in x) == Counter(want[1])


def test_edge_rows(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "?!", 1.0), (None, "w " * 30, 1.0), (5, "w " * 30, 1.0), (5, "w " * 30, 1.0), (6, "z " * 300_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score double")
    gain = I.gains(I.bucket_counts(docs), I.bucket_counts(docs.where("false")))
    out = I.draw(I.with_weights(docs, gain), percent=50)
    assert out.columns == ["doc_id", "text", *I.FIELDS.fieldNames(), "score", "rank"]
    got = out.collect()
    assert len(got) == 7 and sorted(r.rank for r in got if r["rank"]) == [1, 2]
    assert all(r.weight == 0 and r["rank"] is None for r in got if r.n_features == 0)
    assert [r.n_features for r in got if r.doc_id == 6] == [599_999]
    assert I.draw(I.with_weights(docs.where("false"), gain)).count() == 0
