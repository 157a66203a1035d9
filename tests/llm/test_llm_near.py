"""op9 against brute force, with buckets and blocks small enough that all paths are used."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import ngram_join as J
from assaykit.llm.common import table
from assaykit.llm.decontaminate import words_of
from conftest import SF_SMALL


def grams(text, n=5):
    w = words_of(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted((rows[i][0], least[find(i)], links[i]) for i in range(len(rows)))


def planted():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for g in range(12):  # near copies: one to three words changed
        base = [word() for _ in range(80 + 10 * g)]
        for _ in range(6):
            own = list(base)
            for k in rng.choice(len(own), rng.integers(0, 4), replace=False):
                own[k] = word()
            rows.append(" ".join(own))
    for _ in range(60):  # a passage that many share, and nothing else
        rows.append(" ".join(word() for _ in range(rng.integers(20, 120))) + " " + passage)
    rows += ["one two", "One, TWO!", "one two three", "x", ""] + [passage] * 5
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("bucket", [1024, 5, 2])
def test_equal_to_brute_force(spark, bucket):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash")).withColumn("fp", F.lit(1))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.near_groups(df, bucket=bucket).collect())
    assert got == brute(rows)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.near_groups(table(spark, SF_SMALL, "documents")).collect())
    assert got == brute(rows)


def test_edges_and_keep_one(spark):
    long = "w%d " * 400 % tuple(range(400))
    rows = [(3, long, "a"), (1, long.upper(), "b"), (1, long.upper(), "b"), (2, None, "c"), (4, "", "d"), (5, "...", "e"),
            (6, "unique words here", "f"), (6, "other text there", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _near_own string")
    got = J.near_groups(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {
        (3, 1, 2), (1, 1, 2), (2, 2, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0)}
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r._near_own) for r in kept.collect()) == [(1, "b"), (2, "c"), (4, "d"), (5, "e"), (6, "f"), (6, "g")]
    assert J.near_groups(df.where("false")).count() == 0 and J.keep_one(df.where("false")).count() == 0


def test_target_recall():
    assert J.runs_for(0.8, 0.9999, 2, 3) >= 4
    assert J.runs_for(0.8, 0.5, 2, 1) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 103), (102, 103), (5, 5)] + [(200, i) for i in range(201, 230)]
    got = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    want = {i: 0 for i in range(1, 41)} | {101: 100, 102: 100, 103: 100} | {i: 200 for i in range(201, 230)}
    assert got == want


def test_long_texts_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["", "a b", " ".join(rng.choice(list("abc"), 500)), "one " * 300, " ".join(f"w{i}" for i in range(700)), None, "x y z u v w"]
    whole = J.gram_sets(texts)
    for size in (1, 16, 100, 1000):
        monkeypatch.setattr(J, "_TEXT_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(J.gram_sets(texts), whole))


def test_the_least_of_repeated_rows_stays(spark):
    rows = [(1, "some words here that stay", "b", {"k": 1}), (1, "some words here that stay", "a", {"k": 2}), (1, "some words here that stay", "c", {"k": 3})]
    df = spark.createDataFrame(rows, "doc_id long, text string, z string, m map<string,int>")
    for parts in (1, 3):
        assert [(r.z, r.m) for r in J.keep_one(df.repartition(parts)).collect()] == [("a", {"k": 2})]
