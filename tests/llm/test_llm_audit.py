"""op11 against its definition: every order applied to every document."""

from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import filter_audit as A


def brute_shapley(values):
    n = (len(values) - 1).bit_length()
    out = [0] * n
    for order in permutations(range(n)):
        s = 0
        for i in order:
            out[i] += values[s | 1 << i] - values[s]
            s |= 1 << i
    return [Fraction(x, factorial(n)) for x in out]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_least_squares_gives_the_shapley_values(n):
    rng = np.random.default_rng(n)
    for _ in range(5):
        values = [0, *rng.integers(-50, 10 ** 12, (1 << n) - 1).tolist()]
        assert A.shapley(values) == brute_shapley(values)


def audit(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask string, part int")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    text = F.col("_text")
    counts = A.count_masks(docs, [A.too_short(text, 3), A.too_repetitive(text), A.too_many_capitals(text), A.has_signs(text)],
                           labels=labels, marks={"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return A.steps(A.with_shapley(A.coalitions(counts, 5, ["n", "good", "toxic"])), "ABCDE", ["good", "toxic"])


def brute(rows, labels):
    def fails(r):
        t = r[1] or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        return {"A": len(w) < 3, "B": 100 * len(set(w)) < 80 * len(w), "D": any(c in "#$%&*|" for c in t),
                "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                "E": r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == t for o in rows)}

    out = []
    for part in sorted({r[2] or "" for r in rows}):
        of = [r for r in rows if (r[2] or "") == part]
        failing = [fails(r) for r in of]
        good = [any(d == r[0] and q == 1 for d, q, _ in labels) for r in of]
        toxic = [any(d == r[0] and x == 1 for d, _, x in labels) for r in of]
        total = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = list(range(len(of)))
            for step, f in enumerate(order, 1):
                gone = [i for i in left if failing[i][f]]
                left = [i for i in left if not failing[i][f]]
                total[f] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), sum(x[f] for x in failing) - len(gone),
                              sum(x[f] and sum(x.values()) == 1 for x in failing), sum(good[i] for i in gone),
                              sum(toxic[i] for i in gone), f))
        out += [(*x[:-1], Fraction(total[x[-1]], 120)) for x in lines]
    return sorted(out)


def test_all_orders(spark):
    rng = np.random.default_rng(1)
    texts = ["a b c d", "A B", "", None, "a a a a", "x # y z", "one\u00a0two three\tfour", "\x0b \n", "LOUD " * 5, "ß é ü ö", "word " * 40_000]
    rows = [(int(i) if i else None, texts[rng.integers(len(texts))], [None, "", "en", "de"][rng.integers(4)], "m", 1)
            for i in rng.integers(0, 60, 90)]
    labels = [(int(i) if i else None, [0, 1, None][rng.integers(3)], [0, 1, None][rng.integers(3)]) for i in rng.integers(0, 60, 60)]
    got = audit(spark, rows, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    assert sorted((*r[:-1], Fraction(r.shapley.num, r.shapley.den)) for r in got.collect()) == brute(rows, labels)


def test_no_rows_no_parts(spark):
    assert audit(spark, [], []).count() == 0
    with pytest.raises(ValueError, match="not listed"):
        A.steps(spark.range(1), "ABCDEFG", [])
