"""Approximate nearest neighbours by a permutation index.

``PIVOTS`` vectors, the first by a hash of their id, are the pivots (the only sample; every row
is indexed). A vector is represented by its ``PREFIX`` nearest pivots in order. Rows lie in
blocks of about ``BLOCK`` by a hash of id and vector, so a block is a random part of the table; it
files its rows in one inverted list per pivot, with the pivot's place in the row's order. A query
walks the lists of its own nearest pivots, a ``PREFIX`` / ``PIVOTS`` share of the rows each, and adds up
the Spearman footrule distance of the two orders (a pivot that one order lacks counts as place PREFIX + 1).
The ``SHARE`` of a block's rows of least footrule, ``CANDIDATES`` at least, are reranked by the exact
Euclidean distance, and the best ``K`` of each block are merged. A fixed number of candidates would lose
recall as the table grows; a share has the same recall or better at every size. A block's index is
built once, and the queries are streamed past it; only K rows a query and block are moved.

Defined results: vectors null, zero, or with null or non-finite components, and rows with a
null vec_id take no part; a vec_id is asked once (if its rows differ, for the least vector)
and its own rows are no candidates; other repeated rows are candidates each (equal ones K times at
most, as no more can be returned); ties go to the smaller vec_id, and all rows of the last footrule value
are candidates; all vectors that take part have one length, else an
error is raised; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.llm.common import at_most, by_block, cut, ship
from kohort.llm.mtree import _matrix

K, EVERY = 10, 100
PIVOTS, PREFIX = 1024, 64
BLOCK, SHARE, CANDIDATES = 4096, 1 / 8, 250


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    e = F.col("embedding")
    ok = (F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
          & F.exists(e, lambda x: x != 0))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: x.cast("double")).alias("v"))


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of every row, nearest first; ties to the smaller pivot number."""
    out = []
    for at in range(0, len(x), 1024):
        part = x[at:at + 1024]
        d = (part ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * (part @ pivots.T)
        out.append(np.argsort(d, axis=1, kind="stable")[:, :prefix])
    return np.concatenate(out) if out else np.zeros((0, min(prefix, len(pivots))), int)


class InvertedFiles:
    """One list a pivot: the rows that have it in their order, and its place there."""

    def __init__(self, order: np.ndarray, n_pivots: int):
        self.n, self.prefix = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows = (by // self.prefix).astype(np.int32)
        self.places = (by % self.prefix).astype(np.int32)
        self.starts = np.searchsorted(flat[by], np.arange(n_pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of an order to those of all rows."""
        l = self.prefix
        lengths = self.starts[order + 1] - self.starts[order]
        i = np.repeat(np.arange(l), lengths)
        at = np.arange(len(i)) + np.repeat(self.starts[order] - (np.cumsum(lengths) - lengths), lengths)
        j = self.places[at]
        # no pivot shared: each counts its way to place l + 1, twice
        shared = np.bincount(self.rows[at], np.abs(j - i) - (l - j) - (l - i), self.n)
        return l * (l + 1) + shared.astype(np.int64)


class Block:
    """A block's vectors with their inverted files."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, prefix: int):
        self.ids, self.x, self.pivots, self.prefix = ids, x, pivots, prefix
        self.files = InvertedFiles(orders(x, pivots, prefix), len(pivots))

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int, candidates: int):
        """(query ids, ids, distances) of each query's k nearest among its candidates."""
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for i, o in enumerate(orders(q, self.pivots, self.prefix)):
            rows = np.arange(len(self.x))
            if len(rows) > candidates:  # all of the last footrule value that fits stay in
                far = self.files.footrule(o)
                rows = np.flatnonzero(far <= np.partition(far, candidates)[candidates])
            rows = rows[self.ids[rows] != q_ids[i]]
            d = np.sqrt(((self.x[rows] - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((self.ids[rows], d))[:k]
            out[0].append(np.full(len(best), q_ids[i]))
            out[1].append(self.ids[rows[best]])
            out[2].append(d[best])
        return [np.concatenate(c) for c in out]


def search(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, prefix: int = PREFIX, block: int = BLOCK, share: float = SHARE, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, rows whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(at_most(valid(vectors), k))
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components")
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).select("v").toPandas()["v"]  # at most ``pivots`` rows
    centres = np.unique(np.array([np.array(v, float) for v in chosen]).reshape(len(chosen), -1), axis=0)
    n_blocks = max(1, -(-n // block))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = queries.select("vec_id", "v", F.lit(0.0).alias("reach"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"))

    def build(own):
        from kohort.llm.permutation_index import Block
        return Block(own.column("vec_id").to_numpy(), _matrix(own.column("v")), centres, prefix)

    def answer(index, part):
        import pyarrow as pa
        best = max(candidates, int(np.ceil(share * len(index.x))))
        q, i, d = index.nearest(part.column("vec_id").to_numpy(), _matrix(part.column("v")), k, best)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])

    found = by_block(blocks, asked, ["block"], build, answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
