"""op12: suffix orders against sorting, removals against a table of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from assaykit.llm import suffix_dedup as D
from assaykit.llm.common import table
from assaykit.llm.queries import QUERIES
from assaykit.llm.suffix_order import suffix_orders
from conftest import SF_SMALL


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (key, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        n_spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((key, len(r), sum(gone), n_spans, hashlib.sha256(bytes(x for x, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def removed(df, length):
    out = D.remove_repeats(df, length=length).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out), key=str)


def test_orders_of_many_texts():
    rng = np.random.default_rng(5)
    for trial in range(60):
        texts = [rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)).tolist() + [0] for _ in range(rng.integers(1, 9))]
        if trial == 0:
            texts = [[1] * 90 + [0], [2, 1] * 40 + [0], [1, 2, 2] * 30 + [0], [0], list(range(60, 0, -1)) + [0]]
        sizes = [len(t) for t in texts]
        starts = np.cumsum(sizes) - sizes
        got = suffix_orders(np.concatenate([np.array(t, np.int16) for t in texts]), starts)
        for t, s in zip(texts, starts):
            assert (got[s:s + len(t)] - s).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    got = QUERIES["op12_suffix_dedup"](spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = brute(docs, 400)
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(r[2] > 0 for r in want) > 10


def near_copies():
    """Variants of a passage, whole copies, a text in itself, and short alphabets where all windows meet by chance."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    base = [word(6) for _ in range(40)]
    rows = []
    for _ in range(40):
        own = list(base)
        for k in rng.choice(40, 3, replace=False):
            own[k] = word(6)
        rows.append(word(9) + " ".join(own))
    rows += [" ".join(base)] * 4 + ["ab" * 70, "x" * 300, word(50) * 3, "ß" * 60 + word(10) + "ß" * 70]
    rows += ["".join(rng.choice(list("ab"), 200)) for _ in range(30)]
    return rows


@pytest.mark.parametrize("bucket, gather, slices, hot", [(3 << 19, 3 << 20, 1 << 18, 1000), (1500, 4000, 64, 5), (1, 1, 1 << 18, 0)])
def test_all_levels_and_cuts(spark, monkeypatch, bucket, gather, slices, hot):
    monkeypatch.setattr(D, "BUCKET", bucket)
    monkeypatch.setattr(D, "TOGETHER", gather)
    monkeypatch.setattr(D, "SLICE", slices)
    monkeypatch.setattr(D, "LEAST_HOT", hot)
    rows = list(enumerate(near_copies()))
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), 48) == brute(rows, 48)


def test_edge_rows(spark):
    long = "".join(chr(97 + x) for x in np.random.default_rng(1).integers(0, 26, 400_000).tolist())
    rows = [(1, None), (2, ""), (3, "short"), (None, "only once " * 3), (5, "y" * 399), (6, long), (7, "z" + long[1000:1500] + "z"),
            (8, "same row " * 50), (8, "same row " * 50), (9, "q" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "a", 0) for r in rows], "doc_id long, text string, _r0 int, Kept string, n_spans int")
    out = D.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "_r0", *D.FIELDS.fieldNames()]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, [tuple(s) for s in r.removed]) for r in out.collect()}
    assert out.count() == 10
    assert got[6, 400_000] == (500, [(1000, 1500)]) and got[7, 502] == (500, [(1, 501)])
    assert got[8, 450] == (450, [(0, 450)]) and got[9, 100_000] == (100_000, [(0, 100_000)])
    assert all(n == 0 for (d, _), (n, _) in got.items() if d not in (6, 7, 8, 9))
    empty = D.remove_repeats(df.where("false"))
    assert empty.columns == out.columns and empty.count() == 0


def test_window_of_one_level(spark):
    rows = [(1, "abcab"), (2, "xxbcx"), (3, "aa")]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), 2) == brute(rows, 2)
