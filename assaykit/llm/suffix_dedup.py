"""Exact removal of long repeated byte strings by suffix arrays, spread over a cluster.

A window is a string of ``length`` bytes. Its anchor is the least hash of the
shorter strings inside it, so equal windows have equal anchors wherever they
are. A run of neighbouring windows with one anchor is one row; equal runs (by
a 128-bit digest) form a class. All windows of a class with several runs are
repeated. The other repeated windows lie in different classes of one anchor:
one run of each class is fetched, and a suffix array of all runs of an anchor
(``suffix_order``) brings equal windows next to each other, where they are
compared byte by byte.

An anchor whose classes hold more than ``BUCKET`` bytes is dealt again by the
anchors of longer strings inside the windows, up to whole windows, whose runs
are one class. So nothing is capped, and no key needs more than that in one
task. Runs are shuffled once, by anchor; those of the few anchors that hold
more than 1 / ``SPREAD`` of all runs are counted first and met by salt.

Texts stay in ``df``, which is read three times (give a stored table); a row
is known by two 64-bit hashes of its columns.

Defined results: a null text is an empty one; texts shorter than a window lose
nothing; a repeated row is a repeated text, so both lose all windows; matches
never cross documents; overlapping windows of one document count as repeated
too; a table without rows gives none. Other columns pass; those named as a new
one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import append_columns, col, free_prefix, small_batches, without
from assaykit.llm.suffix_order import heads, suffix_orders
from assaykit.session import stored

LENGTH = 400
#: Bytes of the runs of one anchor that go into one suffix array at most.
BUCKET = 3 << 19
#: Bytes of the suffix arrays that are built together (about 60 times that in memory).
TOGETHER = 3 << 20
#: Windows of a text that are hashed at once.
SLICE = 1 << 18
#: Windows in a run at most.
RUN = 512
#: An anchor is a hot one if it has more than this share, and this number, of all runs. So hot ones are SPREAD at most.
SPREAD, LEAST_HOT = 20_000, 1000
#: Tasks that the runs of one class of a hot anchor are spread over.
SALTS = 32

ROW = ["_r0", "_r1"]
RUNS = "_r0 long, _r1 long, start int, n int, anchor long, d0 long, d1 long, weight int, twice boolean"
SEGMENTS = "_r0 long, _r1 long, start int, n int, anchor long, size long, copies boolean, bytes binary"
SPANS = "_r0 long, _r1 long, start int, end int"
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
                      + [T.StructField("removed", T.ArrayType(SPAN)), T.StructField("kept", T.BinaryType())])

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def anchor_lengths(length: int) -> list[int]:
    """Lengths of the strings that anchors are taken from, level by level; the last is the window."""
    return sorted({max(1, length * share // 100) for share in (16, 40, 70, 100)})


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash base and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each string of ``k`` bytes."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    x = (sums[k:] - sums[:-k]) * down[:len(data) - k + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours: the least up to the end of a block and from the begin of the next."""
    n = len(x) - w + 1
    if w == 1:
        return x
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1:w - 1 + n])


def anchor_runs(data: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, windows, anchor, whether the anchor is there twice) of all runs of a text, slice by slice.

    Only a run whose anchor comes at two places can hold two equal windows, as
    texts with a short period do.
    """
    for at in range(0, len(data) - length + 1, SLICE):
        x = gram_hashes(data[at:at + SLICE + length - 1], k)
        low = np.uint64((1 << len(x).bit_length()) - 1)
        place = window_least(x & ~low | np.arange(len(x), dtype=np.uint64), length - k + 1) & low
        anchors = x[place]
        starts = np.flatnonzero(heads(anchors))
        sizes = np.diff(np.append(starts, len(anchors)))
        if sizes.max() > RUN:
            parts = -(-sizes // RUN)
            within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts, sizes = np.repeat(starts, parts) + within * RUN, np.minimum(np.repeat(sizes, parts) - within * RUN, RUN)
        yield starts + at, sizes, anchors[starts].view(np.int64), place[starts] != place[starts + sizes - 1]


def run_rows(texts: Iterator[tuple[int, int, int, int, bytes]], length: int, k: int) -> pa.RecordBatch:
    """Rows of RUNS for (row hashes, place of the bytes in the row's text, weight, bytes)."""
    whole: list[list] = [[] for _ in range(3)]
    arrays: list[list] = [[] for _ in range(4)]
    sizes, digests = [], []
    for r0, r1, base, weight, raw in texts:
        for starts, counts, anchors, twice in anchor_runs(np.frombuffer(raw, np.uint8), length, k):
            sizes.append(len(starts))
            for out, x in zip(whole, (r0, r1, weight)):
                out.append(x)
            for out, x in zip(arrays, (starts + base, counts, anchors, twice)):
                out.append(x)
            digests += [blake2b(raw[a:a + n + length - 1], digest_size=16).digest() for a, n in zip(starts.tolist(), counts.tolist())]
    r0, r1, weight = (np.repeat(np.array(x, np.int64), sizes) for x in whole)
    start, n, anchor, twice = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in arrays)
    digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    columns = [r0, r1, start.astype(np.int32), n.astype(np.int32), anchor, digest[:, 0].copy(), digest[:, 1].copy(),
               weight.astype(np.int32), twice.astype(bool)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns],
                                      names=["_r0", "_r1", "start", "n", "anchor", "d0", "d1", "weight", "twice"])


MARKED = ["_r0", "_r1", "start", "n", "anchor", "size", "copies", "repeated", "wanted"]


def _marked(df: DataFrame) -> DataFrame:
    """MARKED from runs with all (weight of the class), one (whether the row stands for it), m, single, size, any_twice."""
    can = F.col("one") & ((F.col("m") > 1) | F.col("any_twice")) & (F.col("single") > 0)
    return df.withColumn("copies", F.col("all") > 1).withColumn("repeated", F.col("copies") & (F.col("weight") == 1)).withColumn(
        "wanted", can).where("repeated OR wanted").select(*MARKED)


def _anchor_totals(length: int) -> dict:
    first = F.col("one")
    return {"m": F.sum(first.cast("long")), "single": F.sum((first & (F.col("all") == 1)).cast("long")),
            "size": F.sum(F.when(first, (F.col("n") + length).cast("long")).otherwise(0)), "any_twice": F.max("twice")}


def marked_by_anchor(runs: DataFrame, length: int) -> DataFrame:
    """Runs of classes that repeat, and one run of each class that can share windows: one shuffle, by anchor."""
    alike = Window.partitionBy("anchor", "d0", "d1")
    classed = runs.withColumn("all", F.sum("weight").over(alike)).withColumn(
        "one", F.row_number().over(alike.orderBy(*ROW, "start")) == 1)
    return _marked(classed.withColumns({c: x.over(Window.partitionBy("anchor")) for c, x in _anchor_totals(length).items()}))


def marked_by_salt(runs: DataFrame, length: int) -> DataFrame:
    """The same for hot anchors: classes are counted with partial sums, and each salt of a class meets its own rows."""
    salted = runs.withColumn("_salt", F.pmod(F.xxhash64(*ROW, "start"), F.lit(SALTS)))
    classes = stored(salted.groupBy("anchor", "d0", "d1").agg(
        F.sum("weight").alias("all"), F.min(F.struct(*ROW, "start")).alias("least"), F.max("n").alias("n"),
        F.max("twice").alias("twice"), F.collect_set("_salt").alias("salts")), "classes")
    totals = classes.withColumn("one", F.lit(True)).groupBy("anchor").agg(
        *[x.alias(c) for c, x in _anchor_totals(length).items()])
    met = salted.join(classes.select("anchor", "d0", "d1", "all", "least", F.explode("salts").alias("_salt")),
                      ["anchor", "d0", "d1", "_salt"])
    met = met.withColumn("one", F.struct(*ROW, "start") == F.col("least"))
    return _marked(met.join(F.broadcast(totals), "anchor"))  # one row a hot anchor


def marked_runs(runs: DataFrame, length: int) -> DataFrame:
    """MARKED rows of stored ``runs``: hot anchors by salt, all others by anchor."""
    counts = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    least = max(LEAST_HOT, runs.count() // SPREAD)
    hot = [r.anchor for r in counts.where(F.col("n") > least).collect()]
    if not hot:
        return marked_by_anchor(runs, length)
    few = F.broadcast(runs.sparkSession.createDataFrame([(a,) for a in hot], "anchor long"))
    return marked_by_anchor(runs.join(few, "anchor", "left_anti"), length).unionByName(
        marked_by_salt(runs.join(few, "anchor", "left_semi"), length))


def fetch(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs, cut from the texts they are in."""
    per_text = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("start", "n", "anchor", "size", "copies")).alias("_want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, raw, want in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3).to_pylist()):
                raw = raw.as_buffer()
                for at in range(0, len(want), 4096):
                    part = want[at:at + 4096]
                    pieces = [raw[w["start"]:w["start"] + w["n"] + length - 1].to_pybytes() for w in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r0] * len(part), pa.int64()), pa.array([r1] * len(part), pa.int64()),
                         pa.array([w["start"] for w in part], pa.int32()), pa.array([w["n"] for w in part], pa.int32()),
                         pa.array([w["anchor"] for w in part], pa.int64()), pa.array([w["size"] for w in part], pa.int64()),
                         pa.array([w["copies"] for w in part], pa.bool_()), pa.array(pieces, pa.binary())],
                        names=["_r0", "_r1", "start", "n", "anchor", "size", "copies", "bytes"])

    return rows.join(per_text, ROW).select(*ROW, "_raw", "_want").mapInArrow(run, SEGMENTS)


def equal_neighbours(order: np.ndarray, data: np.ndarray, valid: np.ndarray, lane: np.ndarray, length: int) -> np.ndarray:
    """True at the positions whose window equals that of a neighbour in the order of their text's suffixes."""
    hashes = np.zeros(len(data), np.uint64)
    hashes[:len(data) - length + 1] = gram_hashes(data, length)
    a, b = order[:-1], order[1:]
    same = valid[a] & valid[b] & (hashes[a] == hashes[b]) & (lane[a] == lane[b])
    a, b = a[same], b[same]
    # Bytes: where the windows one before are neighbours too, only the last one is new.
    behind = np.full(len(data) + 1, -1, np.int64)
    behind[a] = b
    known = (behind[a - 1] == b - 1) & (a > 0)
    true = data[a + length - 1] == data[b + length - 1]
    check = np.flatnonzero(~known) if true[known].all() else np.arange(len(a))
    inside = np.arange(length)
    for at in range(0, len(check), 4096):
        c = check[at:at + 4096]
        true[c] = (data[a[c][:, None] + inside] == data[b[c][:, None] + inside]).all(axis=1)
    out = np.zeros(len(data), bool)
    out[a[true]] = True
    out[b[true]] = True
    return out


def match(buckets: list[list[tuple]], length: int) -> pa.RecordBatch:
    """Spans of windows that other runs of the same anchor have too; ``buckets`` hold (row hashes, start, copies, bytes)."""
    rows = [r for b in buckets for r in b]
    data = np.frombuffer(b"\0".join(r[4] for r in rows) + b"\0", np.uint8)
    sizes = np.array([len(r[4]) + 1 for r in rows])
    at = np.cumsum(sizes) - sizes
    first = np.cumsum([0] + [len(b) for b in buckets])[:-1]
    starts = at[first]
    # Letters from 2 on; 1 ends a run, and 0 the last one of an anchor.
    codes = data.astype(np.int16) + np.int16(2)
    codes[at + sizes - 1] = 1
    codes[np.append(starts[1:], len(data)) - 1] = 0
    lane = np.repeat(np.arange(len(buckets), dtype=np.int32), np.diff(np.append(starts, len(data))))
    steps = np.zeros(len(data) + 1, np.int8)
    steps[at] += 1
    steps[at + sizes - length] -= 1
    valid = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    found = equal_neighbours(suffix_orders(codes, starts), data, valid, lane, length)
    del codes, lane, valid
    edges = np.flatnonzero(np.diff(found.astype(np.int8), prepend=0, append=0))
    begin, end = edges[::2], edges[1::2]
    row = np.searchsorted(at, begin, side="right") - 1
    single = ~np.array([r[3] for r in rows], bool)[row]
    begin, end, row = begin[single], end[single], row[single]
    r0, r1, start = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    return pa.RecordBatch.from_arrays(
        [pa.array(r0[row]), pa.array(r1[row]), pa.array((start[row] + begin - at[row]).astype(np.int32)),
         pa.array((start[row] + end - at[row] + length - 1).astype(np.int32))], names=["_r0", "_r1", "start", "end"])


def matched_spans(segments: DataFrame, length: int) -> DataFrame:
    """Suffix arrays of all runs of an anchor, many anchors of like size at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, held, anchor, last = [], 0, None, None
        for batch in batches:
            for r0, r1, start, _, a, size, copies, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if a != anchor:
                    if buckets and held + size > TOGETHER:
                        yield match(buckets, length)
                        buckets, held = [], 0
                    buckets.append([])
                    anchor, held, last = a, held + size, None
                if last != (r0, r1, start):  # the same run of a repeated row is one
                    buckets[-1].append((r0, r1, start, copies, raw))
                last = (r0, r1, start)
        if buckets:
            yield match(buckets, length)

    return segments.repartition("anchor").sortWithinPartitions("size", "anchor", *ROW, "start").mapInArrow(run, SPANS)


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """Spans (_r0, _r1, start, end) of all repeated windows of ``rows`` (_r0, _r1, _raw); they may overlap and repeat."""
    levels = anchor_lengths(length)

    def runs_of(texts: DataFrame, k: int, deeper: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if deeper:
                    c = [batch.column(i).to_pylist() for i in (0, 1, 2, 6, 7)]
                    yield run_rows(((a, b, s, 2 if x else 1, raw) for a, b, s, x, raw in zip(*c)), length, k)
                else:
                    yield run_rows(((a, b, 0, 1, raw) for a, b, raw in zip(*(c.to_pylist() for c in batch.columns))), length, k)

        return stored(texts.mapInArrow(run, RUNS), "runs")

    runs = runs_of(rows.where(F.length("_raw") >= length).select(*ROW, "_raw"), levels[0], False)
    spans = []
    for level, k in enumerate(levels):
        marked = stored(marked_runs(runs, length), "marked")
        spans.append(marked.where("repeated").select(*ROW, "start", (F.col("start") + F.col("n") + F.lit(length - 1)).alias("end")))
        last = level + 1 == len(levels)
        fits = F.lit(True) if last else F.col("size") <= BUCKET
        wanted = marked.where("wanted")
        spans.append(matched_spans(fetch(rows, wanted.where(fits), length), length))
        hot = wanted.where(~fits)
        if last or hot.isEmpty():
            break
        runs = runs_of(fetch(rows, hot, length), levels[level + 1], True)
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def cut(raw: bytes, spans: list[dict]) -> tuple[list[dict], bytes]:
    """(maximal spans, the bytes outside them)."""
    merged: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    left = [0, *(b for _, b in merged)]
    right = [*(a for a, _ in merged), len(raw)]
    return [{"start": a, "end": b} for a, b in merged], b"".join(raw[a:b] for a, b in zip(left, right))


def remove_repeats(df: DataFrame, *, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans, removed (spans of bytes) and kept (the other bytes) of its whole texts."""
    if length < 2:
        raise ValueError("a window has two bytes at least")
    small_batches(df.sparkSession)
    rest = without(df, [n for n in FIELDS.fieldNames() if n != text])
    own = free_prefix(rest, "kept")
    known = [col(f.name) for f in rest.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    rows = rest.select(*[col(c).alias(own + c) for c in rest.columns], F.xxhash64(F.lit(0), *known).alias("_r0"),
                       F.xxhash64(F.lit(1), *known).alias("_r1"), F.coalesce(col(text), F.lit("")).cast("binary").alias("_raw"))
    spans = repeated_spans(rows.select(*ROW, "_raw"), length)
    joined = rows.drop("_raw").join(spans.groupBy(*ROW).agg(F.collect_set(F.struct("start", "end")).alias("_spans")), ROW, "left")
    joined = joined.withColumn("_raw", F.coalesce(col(own + text), F.lit("")).cast("binary"))

    def make():
        def work(batch: pa.RecordBatch) -> list:
            at = batch.schema.get_field_index
            done = [cut(raw, s or []) for raw, s in zip(batch.column(at("_raw")).to_pylist(), batch.column(at("_spans")).to_pylist())]
            sizes = [len(x) for x in batch.column(at("_raw")).to_pylist()]
            return [sizes, [n - len(k) for n, (_, k) in zip(sizes, done)], [len(s) for s, _ in done],
                    [s for s, _ in done], [k for _, k in done]]

        return work

    out = append_columns(joined, FIELDS, make)
    return out.select(*[col(own + c).alias(c) for c in rest.columns], *FIELDS.fieldNames())
