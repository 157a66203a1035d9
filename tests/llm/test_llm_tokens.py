"""op3 token counts and op10 token file against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaykit.llm import bpe, token_counts, token_file
from assaykit.session import shared_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", " \n a\n\n b ", "it's <|endoftext|> we'll<|endoftext|>", "x　y 　z",
         "\u001c a \u001c", "é  è" * 3, "tab\t\tx y\t z", "word, word. word; Word!", "日本語のテキスト 混ぜ", "😀 é 1234 ₿½", "a" * 3000,
         "lorem ipsum " * 4000, "of.\nThe thing\r\nand  more", "hello world", "hello world"]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, f"s{i}") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")


def test_counts_equal_the_library(docs, library):
    got = token_counts.count_tokens(docs, PATH)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens"]  # a clashing column is replaced
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    assert all((r.n_tokens, r.n_bytes) == (len(library(r.text)), len((r.text or "").encode())) for r in rows)


def test_counts_of_an_empty_table(docs):
    assert token_counts.count_tokens(docs.where("false"), PATH).count() == 0


def test_proven_strings_encode_alone(library):
    proven = token_counts.prove_whole_tokens(PATH)
    tok = bpe.load(PATH)
    assert len(proven) > 45_000
    for s in proven[::997]:
        assert library(tok.decoder.decode([s])) == [tok.token_to_id(s)]


def test_random_texts(library):
    rng = np.random.default_rng(5)
    alphabet = list("ab ,.'\n\t!?é日1<|>") + ["the ", " of", "  ", "<|endoftext|>", "ing", "'s"]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(400)]
    ids = bpe.Ids(bpe.load(PATH))
    for _ in range(2):
        assert ids.of(pa.array(texts, pa.string())) == [np.array(library(t), "<u4").tobytes() for t in texts]


def test_token_file_round_trip(spark, docs, library):
    path = shared_path(spark, "test-tokens")
    token_file.write_token_file(docs, path, PATH, shards=3, segment_ids=2000)
    rows = token_file.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    by_id = {i if i != 5 else None: t for i, t in enumerate(TEXTS)}
    stream, start = [], 0
    for r in rows:
        ids = [*library(by_id[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    wanted = [0, 1, 7, 7, len(stream) // 2, len(stream) - 1, len(stream), -1, None]
    got = token_file.read_ids(spark, path, spark.createDataFrame([(w,) for w in wanted], "position long")).collect()
    assert sorted((r.position, r.token_id) for r in got) == sorted((w, stream[w]) for w in wanted[:6])


def test_token_file_of_an_empty_table(spark, docs):
    path = shared_path(spark, "test-tokens")
    token_file.write_token_file(docs.where("false"), path, PATH, shards=2)
    assert token_file.read_documents(spark, path).count() == 0


def test_repeated_ids_and_rows(spark, library):
    df = spark.createDataFrame([(1, "b"), (1, "a b c"), (1, "b"), (0, "z")], "doc_id long, text string")
    path = shared_path(spark, "test-tokens")
    token_file.write_token_file(df, path, PATH, shards=2)
    rows = token_file.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [0, 1, 1, 1]
    assert sorted(r.n_tokens for r in rows) == sorted(len(library(t)) + 1 for t in ("b", "a b c", "b", "z"))


@pytest.mark.parametrize("ids", [[], [0], [255, 256], list(range(70_000)), [1 << 31, 3, 0, 1 << 16, 255] * 300,
                                 np.random.default_rng(1).integers(0, 50_257, 5_000).tolist()])
def test_codes(ids):
    codes = token_file.Codes(token_file.encode_codes(np.array(ids, np.uint32)))
    assert len(codes) == len(ids)
    assert codes.slice(0, len(ids)).tolist() == ids
    for a in range(0, len(ids), max(1, len(ids) // 23)):
        assert codes[a] == ids[a]
        assert codes.slice(a, min(len(ids), a + 700)).tolist() == ids[a:a + 700]
    assert codes.slice(len(ids), len(ids)).tolist() == []


def test_counts_and_file_have_no_shuffle_or_one(docs):
    plan = token_counts.count_tokens(docs, PATH).select("doc_id", F.col("n_tokens"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
