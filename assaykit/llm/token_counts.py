"""Token counts by the whole-token shortcut.

Offline proof: each string of the vocabulary is encoded alone; those that give
exactly their own id are proven whole tokens. Counting: a pre-token that is a
proven string counts as one; only the others go through the merges.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special
strings inside a text count as the library's default has it (one token); rows
and columns of the input all stay, repeated rows included.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assaykit.llm import bpe
from assaykit.llm.common import append_columns, kept, texts

FIELDS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def prove_whole_tokens(path: str) -> list[str]:
    """Vocabulary strings (in the library's byte alphabet) that encode alone as one token, their own."""
    tok = bpe.load(path)
    vocab = sorted(tok.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
    plain = [tok.decoder.decode([s]) for s, _ in vocab]
    got = tok.encode_batch_fast(plain, add_special_tokens=False)
    return [s for (s, i), text, e in zip(vocab, plain, got) if e.ids == [i] and "�" not in text]


def _counter(path: str, proven: frozenset) -> bpe.Pieces:
    """Token counts by piece, kept between the tasks of a worker."""
    def table() -> bpe.Pieces:
        tok = bpe.load(path)
        specials = [t.content for t in tok.get_added_tokens_decoder().values()]
        split, merge = tok.pre_tokenizer.pre_tokenize_str, tok.model.tokenize

        def count(piece: str) -> int:
            if any(s in piece for s in specials):
                return len(tok.encode(piece, add_special_tokens=False).ids)
            return sum(1 if p in proven else len(merge(p)) for p, _ in split(piece))

        return bpe.Pieces(count)

    return kept(("token counts", path), table)


def count_tokens(df: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """``df`` with n_bytes (UTF-8) and n_tokens of its whole texts, for a byte-level BPE file.

    The proven strings are at most the vocabulary (about 50,000 short strings),
    sent once to each executor.
    """
    proven = df.sparkSession.sparkContext.broadcast(frozenset(prove_whole_tokens(path)))

    def make():
        table = _counter(path, proven.value)

        def work(batch: pa.RecordBatch) -> list:
            rows = texts(batch, text)
            return [[len(t.encode()) for t in rows], [sum(table.of(t)) for t in rows]]

        return work

    return append_columns(df, FIELDS, make)
