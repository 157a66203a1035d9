"""op7 against brute force over word windows."""

import re

import pytest
from pyspark.sql import functions as F

from assaykit.llm import decontaminate
from assaykit.llm.common import table
from conftest import SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def brute(text, items, n=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall(lower(body))
        size = min(n, len(own))
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.fixture(scope="module")
def items():
    long = "What is the ÉCOLE of the seven seas, and who sailed them first in 1492 under which flag?"
    return [(1, long), (2, "short item"), (2, "short item"), (10, long + " Answer: Colón."), (3, None), (4, "..."), (5, ""),
            (None, "nameless passage of exactly ten words is hidden right here")]


@pytest.fixture(scope="module")
def docs(spark, items):
    texts = [None, "", "no hit here", items[0][1], items[0][1].upper().replace("É", "é"), "a Short\tITEM, and\n\nshort-item again",
             "shortitem", "prefix " + " ".join(items[0][1].split()[2:14]) + " suffix", items[0][1] + " " + items[3][1],
             items[7][1] + ".", ("filler words " * 3000) + items[3][1] + (" more filler" * 3000), items[0][1]]
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Hit_Items string")


@pytest.mark.parametrize("bytes_", [1 << 19, 60])
def test_equal_to_brute_force(spark, docs, items, bytes_):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, automaton_bytes=bytes_)
    assert "Hit_Items" not in got.columns
    rows = got.collect()
    assert len(rows) == 12
    for r in rows:
        assert (r.n_words, r.n_hit, list(r.hit_items)) == brute(r.text, items)
        words = [m.group() for m in WORD.finditer(lower(r.text))]
        for s in r.hit_spans:
            assert WORD.findall(lower(r.text[s.start:s.end])) == words[s.first_word:s.last_word + 1]


def test_empty_benchmark_and_empty_documents(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.find_contamination(docs, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_contamination(docs.where("false"), bench).count() == 0


def test_filter_keeps_clean_rows_and_columns(spark, docs, items):
    kept = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 6]
    assert {r.Hit_Items for r in kept.collect()} == {"x"}


def test_given_tables(spark):
    docs, bench = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = decontaminate.find_contamination(docs, bench).where("n_hit > 0").collect()
    assert got
    for r in got:
        assert (r.n_words, r.n_hit, list(r.hit_items)) == brute(r.text, items)
