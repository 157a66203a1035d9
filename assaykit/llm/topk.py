"""Exact top-k search by inner product with MaxScore.

The terms of a query are the dimensions where it isn't zero, and a term's
postings are the vectors whose component there has the query's sign; its bound
is the largest product it can add. Terms are sorted by bound. Those whose
bounds together stay below the k-th best score so far are non-essential: a
vector found in none of the other (essential) postings can't be among the best.
Essential postings are traversed; the vectors found there are probed in the
other terms, highest bound first, while they can still reach the k-th score.

Vectors are dealt to shards and queries to blocks of bounded size. A task
searches one shard for one block of queries, and the shards' best are merged.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id; a shorter vector has zeros at its end;
a query's own rows (equal id) are left out; equal scores go to the smaller id;
repeated rows of a query count once, repeated candidates each; with fewer than
k candidates all are returned. Products and their sums must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import col, small_batches

SHARD_ROWS, BLOCK_QUERIES = 8192, 2048
_EXACT = 2.0 ** 53
_PROBED = 8  # terms probed between two checks of the bound


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def to_integers(vector: Column, scale: int = 256) -> Column:
    """Each component x as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def _matrix(t: pa.Table) -> np.ndarray:
    a = t.column("vector").combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    sizes = np.diff(a.offsets.to_numpy())
    values = a.values.to_numpy()[a.offsets[0].as_py():a.offsets[-1].as_py()]
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


class Shard:
    """Postings of one shard: for each term (dimension and sign) its vectors and its largest component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # of equal scores the first is the smaller id
        self.ids = ids[order]
        self.by_dim = np.ascontiguousarray(vectors[order].T)
        self.most = {s: np.maximum(s * self.by_dim, 0).max(axis=1, initial=0) for s in (1, -1)}
        self.postings = {s: s * self.by_dim > 0 for s in (1, -1)}
        self.largest = np.abs(self.by_dim).max(initial=0)
        self.as_float: np.ndarray | None = None

    def _values(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Components and query as doubles where all sums are exact in them, else as integers."""
        if float(self.largest) * float(np.abs(query).max(initial=0)) * max(1, len(query)) < _EXACT:
            if self.as_float is None:
                self.as_float = self.by_dim.astype(np.float64)
            return self.as_float, query.astype(np.float64)
        return self.by_dim, query

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score), without rows of id ``own``."""
        dims = min(len(query), len(self.by_dim))
        values, q = self._values(query[:dims])
        sign = np.sign(query[:dims]).astype(int)
        bound = np.where(sign > 0, self.most[1][:dims] * np.maximum(query[:dims], 0),
                         self.most[-1][:dims] * np.maximum(-query[:dims], 0))
        terms = np.argsort(bound, kind="stable")[::-1]  # highest bound first
        open_ = self.ids != own
        at_least = self._seed(values, q, sign, terms[:4], open_, k)
        rest = np.concatenate((np.cumsum(bound[terms][::-1])[::-1], [0]))  # rest[i]: bounds of terms[i:] together
        # Without a threshold every term is essential.
        essential = len(terms) if at_least is None else int(np.argmax(rest < at_least)) if (rest < at_least).any() else len(terms)
        found = np.zeros(len(self.ids), bool)
        for d in terms[:essential]:
            if sign[d]:
                found |= self.postings[sign[d]][d]
        if at_least is None or at_least <= 0:
            found[:] = True  # a vector in no posting has a score of at most 0, which may still do
        found &= open_
        rows = np.flatnonzero(found)
        score = (q[terms[:essential]] @ values[terms[:essential]])[rows]
        for at in range(essential, len(terms), _PROBED):
            if at_least is not None:
                able = score + rest[at] >= at_least
                rows, score = rows[able], score[able]
            some = terms[at:at + _PROBED]
            score = score + q[some] @ values[np.ix_(some, rows)]
        best = np.lexsort((rows, -score))[:k]
        return [(int(self.ids[rows[i]]), int(score[i])) for i in best]

    def _seed(self, values, q, sign, terms, open_, k):
        """A score that k vectors reach: the k-th best of those largest in the leading terms."""
        rows = np.unique(np.concatenate([np.argpartition(-sign[d] * self.by_dim[d], min(32, len(self.ids) - 1))[:32]
                                         for d in terms])) if len(terms) else np.zeros(0, int)
        rows = rows[open_[rows]]
        if len(rows) < k:
            return None
        return np.partition(q @ values[:len(q)][:, rows], -k)[-k]


def _searcher(k: int):
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if queries.num_rows and shard.num_rows:
            postings = Shard(shard.column("id").to_numpy(), _matrix(shard))
            for own, q in zip(queries.column("id").to_pylist(), _matrix(queries)):
                out += [(own, i, s) for i, s in postings.search(own, q, k)]
        ids = list(zip(*out)) if out else ([], [], [])
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), ids)})

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int, *, id_col: str = "vec_id", vector: str = "vector",
          shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest integer inner products of every query.

    ``vector`` holds integers. Two counts decide how many shards and blocks
    there are; a task gets about ``shard_rows`` vectors and ``block_queries``
    queries however large the tables are.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def pick(df: DataFrame) -> DataFrame:
        return df.select(col(id_col).cast("long").alias("id"), col(vector).cast("array<long>").alias("vector")).where(
            F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", F.isnull))

    asked, rows = pick(queries).dropDuplicates(), pick(vectors)
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_queries))
    left = asked.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    # Copies of one vector are dealt by their ids, so they don't meet in one shard.
    right = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(
        _searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
