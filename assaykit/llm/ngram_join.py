"""N-gram Jaccard join by chosen paths, and the groups of near copies that follow from it.

Texts become sets of hashed word n-grams. Texts of one set are one class, which
is joined once. A class has a MinHash sketch: each coordinate holds a token
sampled from its set, the same one for two classes with probability equal to
their Jaccard similarity. A run samples some coordinates and splits the classes
by their tokens there; buckets that are too large are split by size and then
again on newly sampled coordinates, recursively. Small buckets are compared by
brute force: first the sketches, then the whole sets, so every reported link is
exact. Runs are repeated until a pair at the threshold is met with the target
probability.

A pair may meet in many buckets. Every class carries the list of its buckets,
and only the first bucket that two classes share compares them. So links are
counted without writing pairs, and a bucket passes on its links as one row for
each class: the sum of its links and one neighbour that connects it.

A bucket of a few blocks, and one that can be split no further, is cut into
blocks, and the pairs of blocks are compared in different tasks; nothing is
left out.

Defined results: words are runs of 0-9, a-z (after lower-casing A-Z) and
characters beyond ASCII; a text of fewer than n words, but not none, is one
n-gram of all its words; a text without words is a group of its own without
links; repeated rows count as documents of their own, and where one is kept it
is the least of them by all columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import append_columns, col, free_prefix, prefixed, small_batches
from assaykit.llm.decontaminate import words_of
from assaykit.session import stored

N_WORDS, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.9999
COORDINATES = 64      # of a sketch
SAMPLED = 2           # coordinates sampled at each step of a run
DEPTH = 3             # splits on tokens at most
BUCKET = 1024         # classes in a bucket, or a block, that is compared by brute force

SALTS = 32            # tasks that the rows of a large bucket are spread over

_TEXT_BYTES = 1 << 18  # texts hashed at a time

SET_FIELDS = T.StructType([
    T.StructField("fp", T.BinaryType()), T.StructField("n_grams", T.IntegerType()),
    T.StructField("sketch", T.ArrayType(T.IntegerType()))])


def runs_for(threshold: float = THRESHOLD, target: float = TARGET_RECALL, sampled: int = SAMPLED,
             depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is found with the target probability, even if every split is used."""
    once = (1 - (1 - threshold) ** sampled) ** depth
    return math.ceil(math.log(1 - target) / math.log(1 - once))


# ---- sets and sketches -------------------------------------------------------------------------------------------

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_MIN = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    return _mix(np.add.reduceat(_BYTE[data] * (_PLACE[place % 4096] + np.uint64(2) * (place // 4096).astype(np.uint64)),
                                starts) + sizes.astype(np.uint64))


def _gram_hashes(words: list[bytes], n: int) -> np.ndarray:
    hashes = _word_hashes(words)
    grams = hashes[:max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        grams = _mix(grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(grams)])
    return grams


def _long_set(words: list[bytes], n: int) -> np.ndarray:
    """The set of one long text, from slices of words that overlap by n - 1."""
    step = max(1, _TEXT_BYTES // 8)
    parts = [np.unique(_gram_hashes(words[at:at + step + n - 1], n)) for at in range(0, len(words) - n + 1, step)]
    return np.unique(np.concatenate(parts))


def gram_sets(texts: list[str | None], n: int = N_WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text."""
    out: list[np.ndarray] = []
    lists: list[list[bytes]] = []
    size = 0

    def flush() -> None:
        words = [w for ws in lists for w in ws]
        grams = np.zeros(0, np.uint64)
        hashes = grams
        if words:
            hashes = _word_hashes(words)
            grams = hashes[:max(0, len(hashes) - n + 1)].copy()
            for k in range(1, n):
                grams = _mix(grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(grams)])
        at = 0
        for ws in lists:
            if len(ws) >= n:
                out.append(np.unique(grams[at:at + len(ws) - n + 1]))
            elif ws:
                h = np.uint64(len(ws)) + np.zeros(1, np.uint64)
                for k in range(len(ws)):
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k:at + k + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
            at += len(ws)

    for text in texts:
        words = words_of(text)
        if len(text or "") > _TEXT_BYTES and len(words) >= n:
            flush()
            lists, size = [], 0
            out.append(_long_set(words, n))
            continue
        lists.append(words)
        size += len(text or "")
        if size > _TEXT_BYTES:
            flush()
            lists, size = [], 0
    flush()
    return out


def sketch(grams: np.ndarray) -> np.ndarray:
    """The token (its hash) sampled at each coordinate: the least by that coordinate's order."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(grams), 1024):
        least = np.minimum(least, ((grams[at:at + 1024, None] * _MIN) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return least.view(np.int32)


def with_sets(docs: DataFrame, *, n: int = N_WORDS, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the class (fp), the number of distinct n-grams and the sketch (null without words)."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            sets = gram_sets(batch.column(batch.schema.get_field_index(text)).to_pylist(), n)
            return [[xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    [len(s) for s in sets], [sketch(s) if len(s) else None for s in sets]]

        return work

    return append_columns(docs, prefixed(SET_FIELDS, prefix), make)


# ---- chosen paths ------------------------------------------------------------------------------------------------

def _sized(rows: DataFrame, bucket: int) -> DataFrame:
    """path, size, fp of ``rows`` (path, fp) whose path holds two classes or more; written.

    Only paths beyond ``bucket`` are named: there are rows / ``bucket`` of them
    at most, Spark knows the size of their written table and sends it to the
    tasks where it is small; where it isn't, rows meet it by salt. All other
    paths are counted where their rows lie side by side.
    """
    hot = stored(rows.groupBy("path").agg(F.count("*").alias("_size")).where(F.col("_size") > bucket), "hot")
    if hot.isEmpty():
        marked = rows.withColumn("_size", F.lit(None).cast("long"))
    else:
        salts = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = rows.withColumn("_salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salts, ["path", "_salt"], "left")
    small = marked.where("_size IS NULL").withColumn("size", F.count("*").over(Window.partitionBy("path"))).where("size > 1")
    large = marked.where("_size IS NOT NULL").withColumn("size", F.col("_size"))
    return stored(small.unionByName(large).select("path", "size", "fp"), "paths")


def _size_cell(threshold: float) -> Column:
    """Number of grams on a scale where sets of similar size are in the same step or the next."""
    return F.floor(F.log("n_grams") / F.lit(-math.log(threshold)) * F.lit(1 - 1e-9)).cast("int")


def buckets(classes: DataFrame, *, threshold: float = THRESHOLD, runs: int, depth: int = DEPTH,
            sampled: int = SAMPLED, bucket: int = BUCKET) -> DataFrame:
    """path, size, fp: the leaves of all runs, of two classes or more.

    Only paths travel here; sketches are joined where a bucket has to be split.
    A split makes up to ``sampled`` rows of one, so all splits ``sampled`` **
    ``depth``: a bucket of no more blocks than that is left to be cut into them.
    """
    most = bucket * sampled ** depth
    first = classes.select("fp", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(runs * sampled - 1)),
        lambda k: F.xxhash64(k, F.get("sketch", F.pmod(k, F.lit(COORDINATES)))))).alias("path"))
    rows = _sized(first, bucket)
    leaves = rows.where(F.col("size") <= most)
    large = rows.where(F.col("size") > most)
    for level in range(depth):
        if large.isEmpty():
            return leaves
        split = large.select("path", "fp").join(classes.select("fp", "n_grams", "sketch"), "fp")
        if level == 0:  # sets of too different sizes can't be similar: each goes to its own step and the one below
            cell = _size_cell(threshold)
            child = split.select("fp", F.explode(F.array(
                F.xxhash64("path", cell), F.xxhash64("path", cell - 1))).alias("path"))
        else:
            child = split.select("fp", F.explode(F.transform(
                F.sequence(F.lit(0), F.lit(sampled - 1)),
                lambda k: F.xxhash64("path", k, F.get("sketch", F.pmod(F.xxhash64("path", k), F.lit(COORDINATES)).cast("int")))
            )).alias("path"))
        child = _sized(child, bucket)
        last = level == depth - 1
        leaves = leaves.unionByName(child if last else child.where(F.col("size") <= most))
        large = child.where(F.col("size") > most)
    return leaves


def _cells(leaves: DataFrame, bucket: int) -> DataFrame:
    """path, a, b, side, fp: a large leaf is cut into blocks; each pair of blocks (a, b) is a cell."""
    blocks = F.ceil(F.col("size") / F.lit(bucket)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = leaves.withColumn("blocks", blocks).withColumn("own", own)
    return rows.select("path", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "path", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal first columns, across batches."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            now = tuple(c[s].item() for c in cols)
            if now != key:
                if parts:
                    yield key, parts
                key, parts = now, []
            parts.append(batch.slice(s, e - s))
    if parts:
        yield key, parts


def _met_before(path: int, paths: list[np.ndarray]) -> np.ndarray | None:
    """For each pair, whether an earlier bucket has both; None if no pair has."""
    earlier = [p[p < path] for p in paths]
    every = np.concatenate(earlier)
    if not len(every):
        return None
    values, place, count = np.unique(every, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count > 1)
    if not len(keep):
        return None
    rank = np.full(len(values), -1)
    rank[keep] = np.arange(len(keep))
    row, column = np.repeat(np.arange(len(paths)), [len(p) for p in earlier]), rank[place]
    met = np.zeros((len(paths), len(paths)), np.float32)
    row, column = row[column >= 0], column[column >= 0]
    for at in range(0, len(keep), 4096):
        part = (column >= at) & (column < at + 4096)
        m = np.zeros((len(paths), min(4096, len(keep) - at)), np.float32)
        m[row[part], column[part] - at] = 1
        met += m @ m.T
    return met > 0


def _pairs_here(path: int, a: int, b: int, own: np.ndarray, paths: list[np.ndarray]) -> np.ndarray:
    """Which pairs (row < column) this cell compares."""
    todo = np.triu(np.ones((len(own), len(own)), bool), 1)
    if a != b:
        todo &= own[:, None] != own[None, :]
    met = _met_before(path, paths)
    if met is not None:
        todo &= ~met
    return todo


def _alike_sketches(s: np.ndarray, least: int) -> np.ndarray:
    out = np.zeros((len(s), len(s)), bool)
    for i in range(len(s) - 1):
        out[i, i + 1:] = (s[i + 1:] == s[i]).sum(axis=1) >= least
    return out


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: counts over the grams that two sets or more have."""
    every = np.concatenate(sets)
    values, place, count = np.unique(every, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count > 1)
    out = np.zeros((len(sets), len(sets)), np.float32)
    rank = np.full(len(values), -1)
    rank[keep] = np.arange(len(keep))
    row, column = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), rank[place]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, len(keep), 2048):
        lo, hi = np.searchsorted(column, (at, at + 2048))
        m = np.zeros((len(sets), min(2048, len(keep) - at)), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out


def _lists(parts: list[pa.RecordBatch], name: str, dtype) -> list[np.ndarray]:
    out = []
    for p in parts:
        a = p.column(p.schema.get_field_index(name))
        offsets, values = a.offsets.to_numpy(), a.values.to_numpy().astype(dtype, copy=False)
        out += [values[x:y] for x, y in zip(offsets, offsets[1:])]
    return out


def _flat(parts: list[pa.RecordBatch], name: str) -> list:
    return [x for p in parts for x in p.column(p.schema.get_field_index(name)).to_pylist()]


def _sketch_least(threshold: float) -> int:
    """Equal coordinates that a pair at the threshold has but for about one in a million."""
    return math.floor(COORDINATES * threshold - 5 * math.sqrt(COORDINATES * threshold * (1 - threshold)))


def _candidates(least: int):
    """Of each cell, the classes that have a pair to be compared as whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, a, b), parts in _groups(batches, 3):
            fps = _flat(parts, "fp")
            if len(fps) < 2:
                continue
            s = np.stack(_lists(parts, "sketch", np.int32))
            alike = _alike_sketches(s, least)
            if not alike.any():
                continue
            alike &= _pairs_here(path, a, b, np.array(_flat(parts, "own")), _lists(parts, "paths", np.int64))
            on = np.flatnonzero(alike.any(axis=0) | alike.any(axis=1))
            if len(on):
                own, paths = _flat(parts, "own"), _lists(parts, "paths", np.int64)
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * len(on), pa.int64()), "a": pa.array([a] * len(on), pa.int32()),
                    "b": pa.array([b] * len(on), pa.int32()), "own": pa.array([own[i] for i in on], pa.int32()),
                    "paths": pa.array([paths[i] for i in on], pa.list_(pa.int64())),
                    "fp": pa.array([fps[i] for i in on], pa.binary())})

    return run


def _linked(threshold: float):
    """Of each cell, the links of each class: how many documents, and a neighbour (the root of its tree here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, a, b), parts in _groups(batches, 3):
            fps = _flat(parts, "fp")
            if len(fps) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in _flat(parts, "grams")]
            size = np.array([len(x) for x in sets], np.float64)
            both = _overlaps(sets).astype(np.float64)
            links = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            links &= _pairs_here(path, a, b, np.array(_flat(parts, "own")), _lists(parts, "paths", np.int64))
            links |= links.T
            on = np.flatnonzero(links.any(axis=1))
            if not len(on):
                continue
            weight = np.array(_flat(parts, "copies"), np.int64)
            root = np.arange(len(fps))
            for i in on:  # breadth first from each class that has no root yet
                if root[i] != i or (links[i] & (root < i)).any():
                    continue
                seen = np.zeros(len(fps), bool)
                seen[i] = True
                edge = seen.copy()
                while edge.any():
                    edge = links[edge].any(axis=0) & ~seen
                    seen |= edge
                root[seen] = i
            yield pa.RecordBatch.from_pydict({
                "fp": pa.array([fps[i] for i in on], pa.binary()),
                "near": pa.array([fps[root[i]] for i in on], pa.binary()),
                "links": pa.array([int(weight[links[i]].sum()) for i in on], pa.int64())})

    return run


def class_links(docs: DataFrame, classes: DataFrame, *, text: str, n: int, threshold: float, runs: int, depth: int,
                sampled: int, bucket: int) -> DataFrame:
    """fp, near, links: see the module's text. ``classes``: fp, n_grams, sketch, copies, body (hash of one text)."""
    spark = docs.sparkSession
    small_batches(spark)
    leaves = stored(buckets(classes, threshold=threshold, runs=runs, depth=depth, sampled=sampled, bucket=bucket), "leaves")
    # At most runs x sampled paths, a few times more for classes in large buckets.
    lists = leaves.groupBy("fp").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    members = classes.join(lists, "fp").select("fp", "sketch", "paths")
    cells = _cells(leaves, bucket).join(members, "fp").select("path", "a", "b", "own", "paths", "sketch", "fp")
    alike = cells.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b").mapInArrow(
        _candidates(_sketch_least(threshold)), "path long, a int, b int, own int, paths array<long>, fp binary")
    active = stored(alike, "candidates")
    needed = active.select("fp").distinct().join(classes.select("fp", "body", "copies"), "fp")
    bodies = needed.select("body").distinct()
    rows = docs.select(col(text).alias("text")).withColumn("body", F.xxhash64("text")).join(bodies, "body", "left_semi")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = gram_sets(batch.column(0).to_pylist(), n)
            yield pa.RecordBatch.from_pydict({
                "fp": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "grams": pa.array([s.tobytes() for s in sets], pa.binary())})

    texts = rows.select("text", "body").dropDuplicates(["body"]).select("text")
    sets = texts.mapInArrow(grams, "fp binary, grams binary").dropDuplicates(["fp"])
    full = active.join(sets.join(needed.select("fp", "copies"), "fp"), "fp").select(
        "path", "a", "b", "own", "paths", "copies", "fp", "grams")
    return full.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b").mapInArrow(
        _linked(threshold), "fp binary, near binary, links long")


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """node, root: connected components by alternating large-star and small-star steps on a table of edges."""
    e = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = stored(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_groups(docs: DataFrame, *, n: int = N_WORDS, threshold: float = THRESHOLD, target: float = TARGET_RECALL,
                depth: int = DEPTH, sampled: int = SAMPLED, bucket: int = BUCKET, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, body (hash of the text), group_key, class_id, n_links, n_grams.

    ``group_key`` tells groups apart whatever their ids are (null without words);
    ``class_id`` is the least doc_id of the documents that links connect;
    ``n_links`` counts the other documents whose similarity is at least ``threshold``.
    """
    runs = runs_for(threshold, target, sampled, depth)
    keyed = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).withColumn("body", F.xxhash64("text"))
    hashed = stored(with_sets(keyed, n=n).drop("text"), "sets")
    known = hashed.where("fp IS NOT NULL")
    classes = stored(known.groupBy("fp").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("body").alias("body"),
        F.first("n_grams").alias("n_grams"), F.first("sketch").alias("sketch")), "classes")
    found = stored(class_links(docs, classes, text=text, n=n, threshold=threshold, runs=runs, depth=depth,
                               sampled=sampled, bucket=bucket), "links")
    counts = found.groupBy("fp").agg(F.sum("links").alias("links"))
    comps = components(found, "fp", "near")
    roots = comps.unionByName(comps.select(F.col("root").alias("node"), "root").distinct())
    named = roots.join(classes.select(F.col("fp").alias("node"), "least"), "node")
    groups = named.join(named.groupBy("root").agg(F.min("least").alias("group")), "root").select(
        F.col("node").alias("fp"), "root", "group")
    info = classes.select("fp", "copies", "least").join(groups, "fp", "left").join(counts, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("group_key"),
        F.when(F.col("root").isNotNull(), F.col("group")).otherwise(F.col("least")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    with_words = known.select("doc_id", "body", "fp", "n_grams").join(info, "fp").select(
        "doc_id", "body", "group_key", "class_id", "n_links", "n_grams")
    without_words = hashed.where("fp IS NULL").select(
        "doc_id", "body", F.col("fp").alias("group_key"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_grams")
    return with_words.unionByName(without_words)


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each group: the one with the least doc_id (then the least hash of its text); columns as before.

    Documents without words stay all.
    """
    groups = near_groups(docs, text=text, doc_id=doc_id, **options)
    p = free_prefix(docs, "near")
    worded = groups.where("n_grams > 0")
    kept = worded.groupBy("group_key").agg(F.min(F.struct("doc_id", "body")).alias("k")).select(
        F.col("k.doc_id").alias(p + "doc"), F.col("k.body").alias(p + "body"))
    rows = docs.withColumns({p + "own": F.xxhash64(col(text)),
                             p + "words": F.lower(F.coalesce(col(text), F.lit(""))).rlike(r"[0-9a-z\x{80}-\x{10FFFF}]")})
    one = rows.where(F.col(p + "words")).join(
        kept, (F.col(p + "own") == F.col(p + "body")) & col(doc_id).eqNullSafe(F.col(p + "doc")), "left_semi")
    # Of rows with the same doc_id and text the least by all columns that have an order.
    ordered = [col(f.name) for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    least = F.min_by(F.struct(*[col(c) for c in rows.columns]), F.struct(*ordered))
    one = one.groupBy(col(doc_id).alias(p + "key"), col(p + "own").alias(p + "text")).agg(least.alias(p + "row")).select(p + "row.*")
    return one.unionByName(rows.where(~F.col(p + "words"))).select(*[col(c) for c in docs.columns])
