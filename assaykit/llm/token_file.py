"""Token ids in directly addressable codes.

Ids are split into chunks of 8 bits. Level k holds the k-th chunk of every id
that has one; a bitmap at each level but the last says which ids go on, and a
rank directory (ones before every 512 bits) turns a position at one level into
the position at the next. Any id is read with one step a level; nothing before
it is decoded.

A segment row of the table holds whole documents, the positions where they
begin, and the codes. Segments are numbered within a shard in ascending
document order; shards are ranges of document ids. The position of an id in
the whole output is the ids of earlier shards plus the segment's first id plus
the place in the segment.

Defined results: a null text has only the end id; documents of the same id (and
those without, which come first) are ordered by a hash of the text; an empty
table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm import bpe
from assaykit.llm.common import col, kept, small_batches

#: A segment is closed when it holds so many ids. A document is never cut.
SEGMENT_IDS = 1 << 17
_BLOCK = 512  # bits between two entries of a rank directory

SEGMENTS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()),
    T.StructField("first_id", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_starts", T.ArrayType(T.LongType())),
    T.StructField("codes", T.BinaryType()),
])


def encode_codes(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids.

    Layout, little-endian: number of levels (u32), ids at each level (u32 each);
    then for each level its chunks (u8), and unless it is the last, the bitmap
    and the rank directory (u32 each block).
    """
    rest, levels, bitmaps = ids.astype(np.uint32), [], []
    while True:
        levels.append((rest & 0xFF).astype(np.uint8))
        goes_on = rest > 0xFF
        if not goes_on.any():
            break
        bitmaps.append(goes_on)
        rest = rest[goes_on] >> 8
    out = [np.array([len(levels), *map(len, levels)], "<u4").tobytes()]
    for k, chunks in enumerate(levels):
        out.append(chunks.tobytes())
        if k < len(bitmaps):
            bits = np.packbits(bitmaps[k], bitorder="little")
            ones = np.add.reduceat(bitmaps[k].astype(np.uint32), np.arange(0, len(bitmaps[k]), _BLOCK))
            out += [bits.tobytes(), np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4").tobytes()]
    return b"".join(out)


class Codes:
    """Reader of ``encode_codes``: views into the bytes, nothing is decoded up front."""

    def __init__(self, data: bytes):
        n = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", n, 4).tolist()
        at, self.levels, self.bits, self.ranks = 4 + 4 * n, [], [], []
        for k, size in enumerate(sizes):
            self.levels.append(np.frombuffer(data, np.uint8, size, at))
            at += size
            if k < n - 1:
                self.bits.append(np.frombuffer(data, np.uint8, -(-size // 8), at))
                at += -(-size // 8)
                self.ranks.append(np.frombuffer(data, "<u4", -(-size // _BLOCK), at))
                at += 4 * -(-size // _BLOCK)

    def __len__(self) -> int:
        return len(self.levels[0])

    def _rank(self, k: int, i: int) -> int:
        """Ones before bit i at level k: the directory's entry and the bytes from its block on."""
        block = i // _BLOCK
        lead = self.bits[k][block * _BLOCK // 8:i // 8]
        last = int(self.bits[k][i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(self.ranks[k][block]) + int(np.bitwise_count(lead).sum()) + last.bit_count()

    def __getitem__(self, i: int) -> int:
        """The id at a position, by one step a level."""
        value, shift = 0, 0
        for k, chunks in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if k == len(self.bits) or not self.bits[k][i // 8] >> i % 8 & 1:
                return value
            i, shift = self._rank(k, i), shift + 8
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, from the bytes of that range alone."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for k, chunks in enumerate(self.levels):
            if start >= stop:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            if k == len(self.bits):
                break
            low = start // 8
            on = np.unpackbits(self.bits[k][low:-(-stop // 8)], bitorder="little")[start - 8 * low:stop - 8 * low]
            where = where[on.astype(bool)]
            start = self._rank(k, start)
            stop = start + len(where)
        return out


def _encoder(path: str) -> bpe.Ids:
    """Ids by piece, kept between the tasks of a worker."""
    return kept(("token ids", path), lambda: bpe.Ids(bpe.load(path)))


def _segments(path: str, end_id: int | None, segment_ids: int):
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard = _encoder(path), TaskContext.get().partitionId()
        segment, first, docs, starts, parts, n = 0, 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            codes = encode_codes(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()),
                 "first_id": [first], "n_ids": [n], "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                 "doc_starts": pa.array([starts], pa.list_(pa.int64())), "codes": pa.array([codes], pa.binary())})

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), table.of(batch.column(1))):
                data += end
                docs.append(doc)
                starts.append(n)
                parts.append(data)
                n += len(data) // 4
                if n >= segment_ids:
                    yield closed()
                    segment, first, docs, starts, parts, n = segment + 1, first + n, [], [], [], 0
        if docs:
            yield closed()

    return run


def write_token_file(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = 2, shards: int | None = None,
                     doc_id: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode whole texts and write them in ascending document order, as a table at ``path``.

    One shuffle deals the documents to ranges of their ids (ties are told apart
    by a hash of the text, so repeated ids don't meet in one task).
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(col(doc_id).cast("long").alias("doc"), col(text).alias("body"))
    tie = F.xxhash64("body")
    ranged = rows.repartitionByRange(n, F.col("doc"), tie).sortWithinPartitions(F.col("doc"), tie, F.col("body"))
    segments = ranged.mapInArrow(_segments(tokenizer, end_id, segment_ids), SEGMENTS)
    # Uncompressed: a reader can go straight to the byte it needs.
    segments.write.parquet(path, compression="none")


def shard_bases(spark: SparkSession, path: str) -> DataFrame:
    """shard, base (ids of all earlier shards), shard_ids: one row per shard, which are as many as partitions."""
    sizes = spark.read.schema(SEGMENTS).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    rows, base = [], 0
    for r in sorted(sizes.collect(), key=lambda r: r.shard):
        rows.append((r.shard, base, r.shard_ids))
        base += r.shard_ids
    return spark.createDataFrame(rows, "shard int, base long, shard_ids long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the file's codes."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, n, docs, starts, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.ascontiguousarray(Codes(data).slice(0, n), "<u4")  # a segment has all its documents in whole
                ends = [*starts[1:], n]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs, pa.int64()), "shard": pa.array([shard] * len(docs), pa.int32()),
                    "at": [first + a for a in starts], "n_tokens": [b - a for a, b in zip(starts, ends)],
                    "ids_crc32": pa.array(crc, pa.int64())})

    segments = spark.read.schema(SEGMENTS).parquet(path).select(
        "shard", "first_id", "n_ids", "doc_ids", "doc_starts", "codes")
    found = segments.mapInArrow(run, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    bases = F.broadcast(shard_bases(spark, path))  # one row per shard
    return found.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, positions: DataFrame, *, position: str = "position") -> DataFrame:
    """position, token_id: ids at any positions of the whole output, by direct access to their codes.

    Positions that are null or outside the file have no row; repeated ones keep
    theirs. Requests are joined to segments over ranges of ids of a segment's
    least size, so one segment serves its own requests only.
    """
    small_batches(spark)
    bases = F.broadcast(shard_bases(spark, path))
    index = (spark.read.schema(SEGMENTS).parquet(path).select("shard", "segment", "first_id", "n_ids")
             .join(bases, "shard").select("shard", "segment", (F.col("base") + F.col("first_id")).alias("low"), "n_ids"))
    width = SEGMENT_IDS
    cells = index.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("n_ids") - 1) / width))))
    wanted = positions.select(col(position).cast("long").alias("position")).withColumn(
        "cell", F.floor(F.col("position") / width))
    at = wanted.join(cells, "cell").where(
        (F.col("position") >= F.col("low")) & (F.col("position") < F.col("low") + F.col("n_ids"))).select(
        "shard", "segment", "position", (F.col("position") - F.col("low")).alias("place"))
    requests = at.groupBy("shard", "segment", F.floor(F.col("place") / 4096).alias("slot")).agg(
        F.collect_list(F.struct("position", "place")).alias("wanted"))
    codes = spark.read.schema(SEGMENTS).parquet(path).select("shard", "segment", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted, data in zip(*(c.to_pylist() for c in batch.columns)):
                reader = Codes(data)
                yield pa.RecordBatch.from_pydict({
                    "position": pa.array([w["position"] for w in wanted], pa.int64()),
                    "token_id": pa.array([reader[w["place"]] for w in wanted], pa.int64())})

    return requests.join(codes, ["shard", "segment"]).select("wanted", "codes").mapInArrow(
        run, "position long, token_id long")
