"""Cutting texts for byte-level BPE at places where no pre-token can cross.

The byte-level pattern takes one blank together with the letters, digits or
signs behind it, and takes runs of white space otherwise. So a single blank
between two characters that aren't white space always begins a pre-token, and
the pieces on both sides are encoded independently: the ids of a text are those
of its pieces, one after the other. Pieces repeat, so their results are kept in
a table of bounded size; the library encodes only the others.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: White space here is more than what the library takes for it (U+001C to U+001F too), never less.
_SAFE = re.compile(r"(?<=\S) (?=\S)")

#: A word of letters that are surely letters to the library, and a short run of common signs.
_SIGNED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?$&#%*]{1,3})")

#: Pieces kept in a worker at most, and the longest kept one in characters.
KEPT_PIECES, KEPT_CHARS = 600_000, 64


class _Odd(Exception):
    """A piece borders on white space: the simple cut at every blank isn't safe."""


class Pieces(dict):
    """Results by piece (without its leading blank); ``one`` computes them from the piece's full text."""

    def __init__(self, one):
        super().__init__()
        self.one = one

    def __missing__(self, piece: str):
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Odd
        value = self.one(" " + piece)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = value
        return value

    def of(self, text: str) -> list:
        """Results of the pieces of a text, in order."""
        if not text:
            return []
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise _Odd
            return [self.one(first), *map(self.__getitem__, rest)] if first else list(map(self.__getitem__, rest))
        except _Odd:
            first, *rest = _SAFE.split(text)
            return [self.one(first), *map(self._safe, rest)]

    def _safe(self, piece: str):
        try:
            return self[piece]
        except _Odd:  # only the last piece can end in white space
            return self.one(" " + piece)


class Ids(dict):
    """Ids (little-endian, 4 bytes each) by piece without its leading blank; none for an odd one.

    Pieces that aren't in the table are encoded together, as one text of all of
    them: by the rule above its ids are theirs, and the bytes that each id
    stands for show where a piece ends.
    """

    def __init__(self, tok: Tokenizer):
        super().__init__()
        self.tok = tok
        self.signs: dict[str, bytes] = {}
        added = {i: len(t.content.encode()) for i, t in tok.get_added_tokens_decoder().items()}
        self.n_bytes = np.zeros(tok.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in tok.get_vocab(with_added_tokens=True).items():
            self.n_bytes[i] = added.get(i, len(token))  # the byte alphabet has one character a byte

    def _one(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 50_000):
            some = pieces[at:at + 50_000]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.n_bytes[ids])
            wanted = np.cumsum([1 + len(p.encode()) for p in some])
            cuts = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[cuts], wanted):
                raise ValueError("an id reaches across two pieces")
            data, cuts = ids.tobytes(), (4 * (cuts + 1)).tolist()
            self.update(zip(some, (data[a:b] for a, b in zip([0, *cuts], cuts))))

    def _know(self, pieces: list[str]) -> set[str]:
        """Put results of all (different) pieces into the table; returns those that are new."""
        new = {p for p in pieces if p not in self}
        odd = [p for p in new if not p or p[0].isspace() or p[-1].isspace()]
        new.difference_update(odd)
        self.update(dict.fromkeys(odd, b""))
        # A word and the signs behind it are two pre-tokens: words that come with different signs are encoded once.
        signed = [m for m in map(_SIGNED.fullmatch, new) if m]
        new.update(m[1] for m in signed if m[1] not in self)
        new.difference_update(m[0] for m in signed)
        self._learn(list(new))
        for m in signed:
            if m[2] not in self.signs:
                self.signs[m[2]] = self._one(m[2])
            self[m[0]] = self[m[1]] + self.signs[m[2]]
        new.update(m[0] for m in signed)
        return new

    def _safely(self, text: str) -> bytes:
        """The ids of a text with an odd piece: it is cut at blanks between other characters only."""
        first, *rest = _SAFE.split(text)
        return b"".join([self._one(first), *(self.get(p) or self._one(" " + p) for p in rest)])

    def of(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (a string array; null: none).

        The pieces of all texts are numbered by Arrow, each different one is
        looked up once, and the ids are gathered by number.
        """
        if len(self) > KEPT_PIECES:
            self.clear()
        texts = texts.fill_null("")
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        numbered = lists.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        new = self._know(pieces)
        data = list(map(self.__getitem__, pieces))
        heads = number[at[:-1]]
        # The first piece of a text has no blank before it.
        data += [self._one(pieces[k]) if pieces[k] else b"" for k in heads.tolist()]
        hard = {k for k in heads.tolist() if pieces[k][-1:].isspace()}
        number[at[:-1]] = len(pieces) + np.arange(len(heads))
        sizes = np.fromiter(map(len, data), np.int64, len(data)) >> 2
        odd = sizes == 0
        odd[len(pieces):] = [k in hard for k in heads.tolist()]
        starts = np.cumsum(sizes) - sizes
        every = np.frombuffer(b"".join(data), "<u4")
        counts = sizes[number]
        upto = np.concatenate(([0], np.cumsum(counts)))
        ids = every[np.repeat(starts[number] - upto[:-1], counts) + np.arange(upto[-1])].tobytes()
        cuts = (4 * upto[at]).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        some = np.concatenate(([0], np.cumsum(odd[number])))[at]
        for k in np.flatnonzero(some[1:] > some[:-1]).tolist():
            out[k] = self._safely(texts[k].as_py())
        for p in new:  # long pieces seldom come again
            if len(p) > KEPT_CHARS // 4:
                del self[p]
        return out


def load(path: str) -> Tokenizer:
    """The tokenizer of a file. The file must be at the same path on every machine."""
    return Tokenizer.from_file(path)
