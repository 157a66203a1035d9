"""op2 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import topk


def brute(rows, queries, k):
    out = []
    for qid, q in queries:
        scores = sorted((-int(np.dot(np.array(q, object), np.array(v, object))), i) for i, v in rows if i != qid)
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shape", ["normal", "sparse", "negative", "huge", "ties"])
def test_equal_to_brute_force(spark, shape):
    rng = np.random.default_rng(7)
    v = rng.integers(-80, 80, (300, 16))
    if shape == "sparse":
        v[rng.random(v.shape) < 0.8] = 0
    if shape == "negative":
        v = -np.abs(v)
        v[::50] = np.abs(v[::50])
    if shape == "huge":
        v = v * (1 << 22)
    if shape == "ties":
        v[10:200] = v[10]
    rows = [(int(i), [int(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("score", F.lit("clash"))
    queries = [r for r in rows if r[0] % 50 == 0]
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, 5, shard_rows=70, block_queries=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, queries, 5)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, -0.001]),
            (6, []), (None, [1.0, 1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>").where(topk.usable(F.col("e"))).select(
        "vec_id", topk.to_integers(F.col("e")).alias("vector"))
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(7, 65536), (5, 256 * 128 - 512), (6, 0)]
    assert topk.top_k(df.where("false"), df, 5).count() == 0
    assert topk.top_k(df, df.where("false"), 5).count() == 0
    twice = topk.top_k(df.where("vec_id = 0").unionAll(df.where("vec_id = 0")), df, 1).collect()
    assert [(r.query_id, r.vec_id) for r in twice] == [(0, 7)]


def test_terms_are_left_out():
    """With one strong dimension few vectors are looked at: those in its postings."""
    rng = np.random.default_rng(1)
    v = np.zeros((1000, 8), np.int64)
    v[:, 1:] = rng.integers(-2, 3, (1000, 7))
    v[:20, 0] = 100 + np.arange(20)
    shard = topk.Shard(np.arange(1000), v)
    q = np.array([50, 1, 1, 1, 1, 1, 1, 1])
    assert shard.search(-1, q, 5) == [(i, int(v[i] @ q)) for i in sorted(range(1000), key=lambda i: (-int(v[i] @ q), i))[:5]]
