"""Sampled SentencePiece segmentations, and their lossless decoding.

A text is cut where no piece of the vocabulary can cross: between any two
characters that no piece has side by side. The lattice of a chunk has an edge for every piece that matches;
characters without a piece are chains of byte pieces. Forward filtering sums
the weights of all paths to each place; backward sampling walks from the end
and takes an edge with its share of that sum. Since every path passes the cuts,
sampling chunks one by one samples the whole text.

A path's weight is the product of its pieces' weights, (1 + rank) ** -alpha by
the model's own order of pieces.
Each draw is a hash of the row's seed, the chunk's number in the text and the
step, so a row gets the same segmentation in any run, batch or partition.

Lattices of chunks are kept in a table of bounded size; all chunks of a batch
are sampled together, step by step. A chunk of more than ``LONG`` characters,
as in texts that are one long word, is filtered on its own: only the sums are
kept, and the edges are found again, part by part, while it is sampled.

Defined results: a null text is empty and has no ids; a literal U+2581 is
written as bytes, so it isn't taken for a blank when decoding; the seed comes
from any columns (null included), so equal keys give equal segmentations of
equal texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import append_columns, col, free_prefix, kept, prefixed, texts

ALPHA = 1.0
#: Bytes of the edges that a worker keeps from batch to batch at most.
KEPT_BYTES = 32 << 20
#: Chunks of more characters than this are sampled on their own, PART characters at a time.
LONG, PART = 200, 1 << 14
#: Ids from here on stand for a character that is written as its bytes.
BYTES = 1 << 24
_CELLS = 1 << 15  # characters filtered together
_BATCH_CHARS = 1 << 19  # sampled together
_PAIRS = 1 << 22  # places of the table of neighbours; a shared place costs a cut and nothing else

FIELDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())),
                       T.StructField("lossless", T.BooleanType())])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of two neighbouring characters in the table of neighbours."""
    return (a * 0x9E3779B1 ^ b * 0x85EBCA77) >> 7 & _PAIRS - 1


class Vocabulary:
    """Pieces with blanks as blanks, their ids and log weights, and the bytes of every id."""

    def __init__(self, path: str, alpha: float = ALPHA):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.bytes: list[bytes] = [b""] * n
        ranked = sorted((i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))),
                        key=lambda i: -sp.get_score(i))
        # Behind the pieces: a character as bytes (every path has it, so the number of bytes doesn't matter), no piece.
        self.weight = np.full(n + 2, -alpha * math.log(1 + len(ranked)))
        self.weight[-1] = -np.inf
        for rank, i in enumerate(ranked):
            piece = sp.id_to_piece(i).replace("▁", " ")
            self.ids[piece] = i
            self.bytes[i] = piece.encode()
            self.weight[i] = -alpha * math.log(2 + rank)
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value] = i
                self.bytes[i] = bytes([value])
        self.longest = max(map(len, self.ids))
        self._tree()
        self.beside = np.zeros(_PAIRS, bool)
        for piece in self.ids:
            codes = _codes(piece)
            self.beside[_pair(codes[:-1], codes[1:])] = True

    def _tree(self) -> None:
        """Prefixes of the pieces as sorted keys (prefix, next character), and the piece at each prefix."""
        nodes, piece_at = {"": 0}, [-1]
        for piece in self.ids:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(piece_at)
                    piece_at.append(-1)
            piece_at[nodes[piece]] = self.ids[piece]
        keys = sorted((nodes[p[:-1]] << 21 | ord(p[-1]), k) for p, k in nodes.items() if p)
        self.keys = np.array([k for k, _ in keys], np.int64)
        self.child = np.array([c for _, c in keys], np.int64)
        self.piece_at = np.array(piece_at, np.int64)

    def chunks(self, rows: list[str]) -> tuple[list[str], np.ndarray]:
        """The chunks of all rows, one behind the other, and their number by row; a row begins with a blank."""
        whole = "".join([" " + t for t in rows if t])
        if not whole:
            return [], np.zeros(len(rows), np.int64)
        codes = _codes(whole)
        cut = np.ones(len(codes), bool)
        np.logical_not(self.beside[_pair(codes[:-1], codes[1:])], out=cut[1:])
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in rows), np.int64, len(rows))
        ends = np.cumsum(sizes)
        cut[(ends - sizes)[sizes > 0]] = True
        at = np.flatnonzero(cut)
        upto = np.searchsorted(at, ends)
        at = [*at.tolist(), len(whole)]
        return [whole[a:b] for a, b in zip(at, at[1:])], np.diff(upto, prepend=0)

    def match(self, codes: np.ndarray) -> np.ndarray:
        """Ids by [text, end - 1, length - 1] of all pieces in rows of characters (-1 behind their ends); -1: none.

        A character that no piece stands for has BYTES plus its code at length 1.
        """
        n, most = codes.shape
        out = np.full((n, most, min(self.longest, most)), -1, np.int32)
        found = 1
        row, start = np.nonzero(codes >= 0)
        node = np.zeros(len(row), np.int64)
        for size in range(1, out.shape[2] + 1):
            key = node << 21 | codes[row, start + size - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            live = self.keys[at] == key
            if size == 1:
                out[row, start, 0] = np.where(live & (self.piece_at[self.child[at]] >= 0), -1, BYTES + codes[row, start])
            row, start, node = row[live], start[live], self.child[at[live]]
            piece = self.piece_at[node]
            hit = piece >= 0
            if hit.any():
                out[row[hit], start[hit] + size - 1, size - 1] = piece[hit]
                found = size
            inside = start + size < most
            row, start, node = row[inside], start[inside], node[inside]
            if not len(row):
                break
        return out[:, :, :found]

    def decode(self, ids: list[int]) -> bytes:
        """The text (UTF-8) of any segmentation, without the blank that encoding puts first."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


class Lattices:
    """Filtered lattices of chunks: the edges into each node with their cumulative shares.

    A node stands behind each character of a chunk; its edges lie side by side,
    shortest first, from ``starts`` on. All new chunks of a batch are matched
    and filtered together, place by place.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        """Forget all chunks."""
        self.ends: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.starts = np.empty(1 << 16, np.int32)
        self.shares = np.empty(1 << 16, np.float32)
        self.froms = np.empty(1 << 16, np.int32)  # the node it comes from; -1: the start
        self.ids = np.empty(1 << 16, np.int32)    # from BYTES on: a character as bytes

    @property
    def nbytes(self) -> int:
        return 4 * self.nodes + 12 * self.edges

    def _fill(self, name: str, at: int, values: np.ndarray) -> None:
        array, upto = getattr(self, name), at + len(values)
        if upto > len(array):
            grown = np.empty(upto + upto // 2, array.dtype)  # what isn't filled yet takes no memory
            grown[:at] = array[:at]
            setattr(self, name, grown)
            array = grown
        array[at:upto] = values

    def edge(self, node: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Of each node the edge that a draw falls on."""
        at = self.starts[node].astype(np.int64)
        left = np.flatnonzero(self.shares[at] <= draws)
        while len(left):
            at[left] += 1
            left = left[self.shares[at[left]] <= draws[left]]
        return at

    def add(self, chunks: list[str]) -> None:
        """Forward filtering of new chunks."""
        chunks = sorted(chunks, key=len)
        at = 0
        while at < len(chunks):
            end = at + 1
            while end < len(chunks) and (end - at + 1) * len(chunks[end]) <= _CELLS:
                end += 1
            self._add(chunks[at:end])
            at = end

    def _add(self, chunks: list[str]) -> None:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        n, most = len(chunks), int(sizes.max())
        codes = np.full((n, most), -1, np.int64)
        codes[np.arange(most) < sizes[:, None]] = _codes("".join(chunks))
        found = self.vocab.match(codes)  # [chunk, end - 1, length - 1]
        weight, as_bytes = self.vocab.weight, len(self.vocab.weight) - 2
        shares = np.ones(found.shape, np.float32)
        total = np.full((n, most + 1), -np.inf)
        total[:, 0] = 0
        for e in range(1, most + 1):
            reach = min(e, found.shape[2])
            logs = total[:, e - reach:e][:, ::-1] + weight[np.minimum(found[:, e - 1, :reach], as_bytes)]
            top = logs.max(axis=1)
            top[np.isinf(top)] = 0  # behind the chunk's end
            run = np.exp(logs - top[:, None]).cumsum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                total[:, e] = top + np.log(run[:, -1])
                shares[:, e - 1, :reach] = run / run[:, -1:]
        cells = np.arange(most) < sizes[:, None]
        found, shares = found[cells], shares[cells]  # one row a node, chunk after chunk
        place = np.broadcast_to(np.arange(most), (n, most))[cells]
        node, length = np.nonzero(found >= 0)
        share = shares[node, length]
        share[np.append(node[1:] != node[:-1], True)] = 2  # beyond any draw
        froms = np.where(length == place[node], -1, self.nodes + node - length - 1)
        self._fill("starts", self.nodes, self.edges + np.searchsorted(node, np.arange(len(found))))
        for name, x in (("shares", share), ("froms", froms), ("ids", found[node, length])):
            self._fill(name, self.edges, x)
        self.edges += len(node)
        self.ends.update(zip(chunks, (self.nodes + np.cumsum(sizes) - 1).tolist()))
        self.nodes += len(found)

    def long(self, chunk: str, draw: int) -> list[int]:
        """Sampled ids of one long chunk, from its end: sums forward, then edges and draws part by part."""
        codes, weight, as_bytes = _codes(chunk), self.vocab.weight, len(self.vocab.weight) - 2
        reach = self.vocab.longest

        def edges(start: int, end: int) -> list[list[tuple[int, int]]]:
            """(length, id) of all edges into the nodes behind the characters from start to end."""
            low = max(0, start - reach + 1)
            found = self.vocab.match(codes[None, low:end])[0, start - low:]
            out: list[list[tuple[int, int]]] = [[] for _ in range(end - start)]
            for node, length in zip(*(x.tolist() for x in np.nonzero(found >= 0))):
                out[node].append((length + 1, int(found[node, length])))
            return out

        power = np.exp(weight).tolist()
        total = np.zeros(len(codes) + 1)
        before, base = [1.0], 0.0  # sums of the last places, as multiples of e ** base
        for start in range(0, len(codes), PART):
            values = before
            lead = len(values)
            for k, into in enumerate(edges(start, min(start + PART, len(codes)))):
                now = 0.0
                for length, i in into:
                    now += values[-length] * power[i if i < as_bytes else as_bytes]
                values.append(now)
                if now < 1e-200:  # keep the sums in range
                    done = values[lead:]
                    total[start + 1 + k + 1 - len(done):start + k + 2] = np.log(done) + base
                    base += math.log(now)
                    values = [x / now for x in values[-reach:]]
                    lead = len(values)
            done = values[lead:]
            stop = min(start + PART, len(codes))
            if done:
                total[stop + 1 - len(done):stop + 1] = np.log(done) + base
            before = values[-reach:]
        out, at, step, start, into = [], len(codes), 0, len(codes), []
        while at:
            if at <= start:
                start = max(0, at - PART)
                into = edges(start, at)
            options = into[at - 1 - start]
            shares = [math.exp(total[at - length] + weight[min(i, as_bytes)] - total[at]) for length, i in options]
            u = _draws(np.array([draw], np.uint64), step)[0] * sum(shares)
            for (length, i), share in zip(options, shares):
                u -= share
                if u < 0:
                    break
            out.append(i)
            at, step = at - length, step + 1
        return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _draws(seeds: np.ndarray, step: int) -> np.ndarray:
    """Draws from 0 to 1 by the chunks' seeds and the step."""
    return (_mix(seeds + np.uint64(step)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


def _written(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Ids with the characters that are written as bytes as their byte pieces."""
    whole = ids < BYTES
    if whole.all():
        return ids
    out: list[int] = []
    for i in ids.tolist():
        out += [i] if i < BYTES else [vocab.byte_ids[b] for b in chr(i - BYTES).encode()]
    return np.array(out, np.int32)


def sample(lattices: Lattices, rows: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows after each other, and the offsets of the rows."""
    vocab = lattices.vocab
    chunks, counts = vocab.chunks(rows)
    new = set(chunks).difference(lattices.ends)
    apart = {c for c in new if len(c) > LONG}
    if len(new) > len(apart):
        lattices.add(list(new - apart))
    lattices.ends.update(dict.fromkeys(apart, -1))
    node = np.fromiter(map(lattices.ends.__getitem__, chunks), np.int64, len(chunks))
    for c in apart:
        del lattices.ends[c]
    first = np.cumsum(counts) - counts
    number = np.arange(len(chunks)) - np.repeat(first, counts)
    draw = np.repeat(_mix(seeds.astype(np.int64).view(np.uint64)), counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    draw = _mix(draw)
    length = np.zeros(len(chunks), np.int64)
    alone = {k: _written(vocab, np.array(lattices.long(chunks[k], int(draw[k]))[::-1], np.int32)) for k in np.flatnonzero(node < 0).tolist()}
    for k, got in alone.items():
        length[k] = len(got)
    steps = []
    live = np.flatnonzero(node >= 0)
    step = 0
    while len(live):
        edge = lattices.edge(node[live], _draws(draw[live], step))
        got = lattices.ids[edge]
        steps.append((live, got, length[live]))
        code = got - BYTES
        length[live] += np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        came = lattices.froms[edge]
        node[live] = came
        live = live[came >= 0]
        step += 1
    upto = np.concatenate(([0], np.cumsum(length)))
    ids = np.zeros(int(upto[-1]), np.int32)
    for who, what, behind in steps:
        whole = what < BYTES
        last = upto[who + 1] - behind
        ids[last[whole] - 1] = what[whole]
        for k in np.flatnonzero(~whole).tolist():
            data = chr(what[k] - BYTES).encode()
            ids[last[k] - len(data):last[k]] = [vocab.byte_ids[b] for b in data]
    for k, got in alone.items():
        ids[upto[k]:upto[k + 1]] = got
    if lattices.nbytes > KEPT_BYTES:
        lattices.clear()
    return ids, upto[np.append(first, len(chunks))]


def _lattices(path: str, alpha: float) -> Lattices:
    return kept(("lattices", path, alpha), lambda: Lattices(Vocabulary(path, alpha)))


def encode(docs: DataFrame, path: str, *, key: list[str | Column], seed: int = 0, alpha: float = ALPHA,
           text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ids, a segmentation of the whole text sampled by the row's key, and lossless.

    ``lossless`` says that decoding the ids gave back the text. ``alpha``
    sharpens (above 1) or flattens (towards 0) the weights of the pieces.
    """
    own = free_prefix(docs, "seed") + "value"
    keys = [k if isinstance(k, Column) else col(k) for k in key]
    seeded = docs.withColumn(own, F.xxhash64(*keys, F.lit(seed)))

    def make():
        lattices = _lattices(path, alpha)

        def work(batch: pa.RecordBatch) -> list:
            rows, seeds = texts(batch, text), batch.column(batch.schema.get_field_index(own)).to_numpy()
            arrays, good = [], []
            at = 0
            while at < len(rows):
                end, size = at, 0
                while end < len(rows) and (end == at or size + len(rows[end]) <= _BATCH_CHARS):
                    size += len(rows[end])
                    end += 1
                ids, upto = sample(lattices, rows[at:end], seeds[at:end])
                as_list = ids.tolist()
                good += [lattices.vocab.decode(as_list[a:b]) == t.encode()
                         for t, a, b in zip(rows[at:end], upto.tolist(), upto[1:].tolist())]
                arrays.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32())))
                at = end
            return [pa.concat_arrays(arrays), good]

        return work

    return append_columns(seeded, prefixed(FIELDS, prefix), make).drop(own)


def decode(rows: DataFrame, path: str, *, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the texts of their ids (null ids give null)."""
    fields = T.StructType([T.StructField(to, T.StringType())])

    def make():
        vocab = _lattices(path, ALPHA).vocab

        def work(batch: pa.RecordBatch) -> list:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            return [[None if x is None else vocab.decode(x).decode("utf-8", "replace") for x in lists]]

        return work

    return append_columns(rows, fields, make)
