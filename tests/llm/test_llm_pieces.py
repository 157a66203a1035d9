"""op4: lossless, reproducible, and distributed as the lattice says."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from assaykit.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", "a", " ", "a  b", "x▁y", " \n\t\x00z", "ﬁ① 日本語テキスト", "😀 é" * 3, "a" * 5000, " " * 100, "</s> <s> <unk>", "the cat",
         "the cat", "word " * 20_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i % 13 if i != 3 else None, t, "kept") for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, IDS string")


def test_lossless_and_reproducible(spark, docs):
    got = pieces.encode(docs, PATH, key=["doc_id"], seed=3)
    assert got.columns == ["doc_id", "text", "ids", "lossless"]
    rows = {(r.doc_id, r.text): r.ids for r in got.collect()}
    assert all(r.lossless for r in got.collect())
    again = {(r.doc_id, r.text): r.ids for r in pieces.encode(docs.repartition(7), PATH, key=["doc_id"], seed=3).collect()}
    other = {(r.doc_id, r.text): r.ids for r in pieces.encode(docs, PATH, key=["doc_id"], seed=4).collect()}
    assert rows == again and rows != other
    back = pieces.decode(got.select("doc_id", "ids"), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for t in TEXTS)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert all(sp.decode(list(ids)) == (t or "") for (_, t), ids in rows.items())
    assert pieces.encode(docs.where("false"), PATH, key=["doc_id"]).count() == 0


def enumerate_paths(vocab, text):
    s, out = " " + text, {}

    def walk(i, ids, w):
        if i == len(s):
            out[tuple(ids)] = math.exp(w)
            return
        for e in range(i + 1, min(len(s), i + vocab.longest) + 1):
            if (k := vocab.ids.get(s[i:e])) is not None:
                walk(e, [*ids, k], w + vocab.weight[k])
        if s[i] not in vocab.ids:
            walk(i + 1, ids + [vocab.byte_ids[b] for b in s[i].encode()], w)

    walk(0, [], 0.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


@pytest.mark.parametrize("text", ["hello", "a①b", "the cat", "a  b"])
def test_samples_follow_the_lattice(text):
    lattices = pieces.Lattices(pieces.Vocabulary(PATH))
    n = 20_000
    ids, upto = pieces.sample(lattices, [text] * n, np.arange(n))
    ids = ids.tolist()
    seen = Counter(tuple(ids[a:b]) for a, b in zip(upto, upto[1:]))
    expected = enumerate_paths(lattices.vocab, text)
    assert set(seen) <= set(expected)
    assert all(abs(seen[k] / n - p) < 0.015 for k, p in expected.items())


def test_a_full_table_is_emptied_without_a_change(monkeypatch):
    texts = [f"word{i} thing{i * 7}" for i in range(300)]
    vocab = pieces.Vocabulary(PATH)
    seeds = np.arange(300)
    whole = pieces.sample(pieces.Lattices(vocab), texts, seeds)[0].tolist()
    monkeypatch.setattr(pieces, "KEPT_BYTES", 2000)
    small = pieces.Lattices(vocab)
    parts = [x for k in range(0, 300, 10) for x in pieces.sample(small, texts[k:k + 10], seeds[k:k + 10])[0].tolist()]
    assert parts == whole


def test_the_table_is_bounded_after_adding(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 1_000_000)
    lattices = pieces.Lattices(pieces.Vocabulary(PATH))
    kept, rng = [], np.random.default_rng(1)
    for k in range(20):
        text = " ".join("".join(rng.choice(list("etaoinshr"), 9)) for _ in range(900))
        pieces.sample(lattices, [text], np.array([k]))
        kept.append(lattices.nbytes)
        assert sum(getattr(lattices, n).nbytes for n in ("starts", "shares", "froms", "ids")) < 3 * pieces.KEPT_BYTES
    assert max(kept) <= pieces.KEPT_BYTES and any(b < a for a, b in zip(kept, kept[1:]))  # it was full and is small again


@pytest.mark.parametrize("text", ["hello", "a①b", "a  b", "xyxyxyx"])
def test_long_chunks_follow_the_lattice_too(monkeypatch, text):
    """Every chunk on its own, in parts shorter than a piece."""
    monkeypatch.setattr(pieces, "LONG", 0)
    monkeypatch.setattr(pieces, "PART", 3)
    lattices = pieces.Lattices(pieces.Vocabulary(PATH))
    n = 6000
    ids, upto = pieces.sample(lattices, [text] * n, np.arange(n))
    ids = ids.tolist()
    seen = Counter(tuple(ids[a:b]) for a, b in zip(upto, upto[1:]))
    expected = enumerate_paths(lattices.vocab, text)
    assert set(seen) <= set(expected) and lattices.nodes == 0
    assert all(abs(seen[k] / n - p) < 0.03 for k, p in expected.items())


def test_texts_without_blanks_stay_lossless():
    rng = np.random.default_rng(0)
    vocab = pieces.Vocabulary(PATH)
    lattices = pieces.Lattices(vocab)
    base64 = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 60_000))
    chinese = "".join(map(chr, rng.integers(0x4E00, 0x9000, 60_000)))
    rows = [base64, chinese, "a" * 30_000, "短い " + base64[:500], "", "①" * 3000]
    for _ in range(2):
        ids, upto = pieces.sample(lattices, rows, np.arange(len(rows)))
        assert [vocab.decode(ids[a:b].tolist()).decode() for a, b in zip(upto, upto[1:])] == rows
    assert len(ids[upto[0]:upto[1]]) < 55_000


def test_cuts_are_where_no_piece_crosses():
    vocab = pieces.Vocabulary(PATH)
    texts = ["Hello, world! (a-b) 12:30 日本語 x▁y  z", "", "don't;stop", "ünïcödé…"]
    chunks, counts = vocab.chunks(texts)
    assert "".join(chunks) == "".join(" " + t for t in texts if t) and counts.sum() == len(chunks) and counts[1] == 0
    whole = [" " + t for t in texts if t]
    for w in whole:
        for i in range(len(w)):
            for e in range(i + 2, min(len(w), i + vocab.longest) + 1):
                if w[i:e] in vocab.ids:
                    assert vocab.beside[pieces._pair(pieces._codes(w[i:e - 1]), pieces._codes(w[i + 1:e]))].all()
