"""Benchmark decontamination with one Aho-Corasick automaton.

The words of every benchmark text (its questions and answers) are cut into
windows of ``n`` consecutive words; all windows go into one automaton, and each
document is normalised and scanned once. Matches are mapped back to word and
character positions of the original text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. The
normalised form is the UTF-8 bytes with every other byte as a separator, which
gives the same words: bytes from 0x80 belong to characters beyond ASCII.

Defined results: a null text has no words; an item of fewer than ``n`` words is
one window, an item without words has none; repeated items and windows count
once per item id; a null item id marks words but is not listed; an empty
benchmark table hits nothing; documents keep all rows and columns, repeated
rows included.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import append_columns, col, free_prefix, kept, prefixed, texts
from assaykit.session import stored

#: Bytes of benchmark text in one automaton at most; a worker holds about 300 times that.
#: A larger benchmark is scanned in several passes.
AUTOMATON_BYTES = 1 << 19

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
              for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
                     T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(SPAN)),
])

def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 bytes."""
    return (text or "").encode().translate(_FOLD).split()


def windows_of(text: str | None, n: int) -> list[str]:
    """Normalised windows, one byte a character, with a blank on both sides."""
    words = words_of(text)
    if not words:
        return []
    return [(b" " + b" ".join(words[k:k + n]) + b" ").decode("latin-1") for k in range(max(1, len(words) - n + 1))]


def _automaton(key: str, items: list[tuple[str | None, str]], n: int):
    def build():
        owners: dict[str, set] = {}
        for item, text in items:
            for w in windows_of(text, n):
                owners.setdefault(w, set()).add(item)
        auto = ahocorasick.Automaton()
        for w, ids in owners.items():
            auto.add_word(w, (w.count(" ") - 1, ids))
        if owners:
            auto.make_automaton()
        return auto if owners else None

    return kept(("automaton", key), build)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan_text(auto, text: str) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, hit ranges of words (first, last) and the items of the windows found."""
    line = b" ".join(words_of(text)).decode("latin-1")
    if not line:
        return 0, [], set()
    line = f" {line} "
    found = list(auto.iter(line)) if auto is not None else []
    if not found:
        return line.count(" ") - 1, [], set()
    ranges, items, at, seen = [], set(), 0, 0
    for end, (n, ids) in found:  # ends ascend, so blanks are counted once
        seen += line.count(" ", at, end)
        at = end
        ranges.append((seen - n, seen - 1))
        items |= ids
    return line.count(" ") - 1, _merged(ranges), items


def _scanner(key: str, shared, n: int, text: str, prior: str):
    def make():
        auto = _automaton(key, shared.value, n)

        def work(batch: pa.RecordBatch) -> list:
            before = None
            if prior:
                before = [batch.column(batch.schema.get_field_index(prior + f)).to_pylist()
                          for f in ("hit_items", "hit_spans")]
            out: list[list] = [[], [], [], []]
            for i, t in enumerate(texts(batch, text)):
                n_words, ranges, items = scan_text(auto, t)
                if before:
                    ranges = _merged(ranges + [(s["first_word"], s["last_word"]) for s in before[1][i]])
                    items = items | set(before[0][i])
                spans = []
                if ranges:
                    at = [m.span() for m in _WORD.finditer(t)]
                    spans = [{"first_word": a, "last_word": b, "start": at[a][0], "end": at[b][1]} for a, b in ranges]
                out[0].append(n_words)
                out[1].append(sum(b - a + 1 for a, b in ranges))
                out[2].append(sorted(x for x in items if x is not None))
                out[3].append(spans)
            return out

        return work

    return make


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text: str = "text",
                       item_id: str = "item_id", item_text: str = "text",
                       automaton_bytes: int = AUTOMATON_BYTES, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (ids as sorted strings) and hit_spans.

    Spans hold word positions and character offsets (end exclusive) of the
    original text. ``prefix`` goes before the names of the new columns. The benchmark's size is measured first: each pass takes
    ``automaton_bytes`` of it, so what is sent to the workers is bounded; one
    pass needs no shuffle, further ones go through a written table.
    """
    spark = docs.sparkSession
    items = benchmark.select(col(item_id).cast("string").alias("item"), col(item_text).alias("body")).where(
        F.col("body").isNotNull())
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    passes = max(1, -(-size // automaton_bytes))
    part = F.pmod(F.xxhash64("item", "body"), F.lit(passes))
    fields, before = prefixed(FIELDS, prefix), free_prefix(docs, "before")
    out = docs
    for k in range(passes):
        again = k > 0
        rows = [(r.item, r.body) for r in items.where(part == k).collect()]
        shared = spark.sparkContext.broadcast(rows)
        if again:
            out = stored(out, "decontaminate").withColumns(
                {before + f: F.col(prefix + f) for f in ("hit_items", "hit_spans")})
        out = append_columns(out, fields, _scanner(uuid.uuid4().hex, shared, n, text, before if again else ""))
        if again:
            out = out.drop(before + "hit_items", before + "hit_spans")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text: str = "text",
                  max_hit_share: float = 0.0) -> DataFrame:
    """Drop the documents whose share of hit words is above ``max_hit_share``; columns stay as they are."""
    p = free_prefix(docs, "hits")
    found = find_contamination(docs, benchmark, n=n, text=text, prefix=p)
    clean = found.where((F.col(p + "n_hit") == 0) |
                        (F.col(p + "n_hit") <= F.lit(max_hit_share) * F.col(p + "n_words")))
    return clean.select(*[col(c) for c in docs.columns])
