"""Exact top-k inner products by best-first search of M-trees.

Inner products become distances: with M the largest norm, vectors x get one more coordinate,
sqrt(M^2 - |x|^2), queries a zero, and |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest are
those of the highest product. The tree has two tiers:

* the root is a table of ``PIVOTS`` routing vectors with the covering radius of what is
  nearest to each; it is of fixed size and goes to every task;
* below each routing vector lie blocks of at most about ``BLOCK`` vectors (a region with many
  is split by a hash of id and vector, so a hot region is many tasks). A task builds the M-tree
  of a block, once, and streams the block's queries past it: pages of routing objects with
  covering radius and distance to the parent object, and leaf pages with the vectors' distances
  to theirs.

A query first searches one block of its nearest region, which bounds its k-th distance; then
only the blocks of regions whose ball reaches inside that bound. In a page, entries whose
stored parent distance already rules them out (triangle inequality) cost no computation; the
rest go to a queue ordered by the least distance they can hold, until that exceeds the bound.
Scores are exact integers, bounds have a slack far below the least gap of two scores.

Defined results: vectors null or with null or non-finite components, and rows with a null
vec_id, take no part; a vec_id is asked once (if its rows differ, for the least vector) and
its own rows are no candidates; other repeated rows are candidates each (equal ones K times at
most, as no more can be returned); all vectors that take
part have one length, else an error is raised, as is for products beyond 2^52; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.llm.common import at_most, by_block, cut, ship

K, SCALE, EVERY = 20, 64, 20
PIVOTS, BLOCK, PAGE = 16, 4096, 512
SLACK = 1e-6


class MTree:
    """M-tree of augmented vectors, bulk loaded; pages hold at most PAGE entries."""

    def __init__(self, x: np.ndarray, m2: float):
        self.x, self.m2 = x, m2
        # products are whole numbers of at most m2: below 2^24 they are exact in single precision
        self.kind = np.float32 if m2 < 2 ** 24 else np.float64
        # a page: (is leaf, objects, radii, distances to the parent object, children or row numbers)
        self.pages: list[tuple] = []
        self.root = self._load(np.arange(len(x)), None)

    def _load(self, rows: np.ndarray, parent) -> int:
        x = self.x[rows]
        to_parent = np.zeros(len(rows)) if parent is None else np.sqrt(((x - parent) ** 2).sum(axis=1))
        at = len(self.pages)
        if len(rows) <= PAGE:
            self.pages.append((True, np.ascontiguousarray(x[:, :-1], self.kind), 0.0, to_parent, rows))  # without the added coordinate
            return at
        self.pages.append(())
        n = min(PAGE, -(-2 * len(rows) // PAGE))
        objects = x[np.linspace(0, len(rows) - 1, n).astype(int)]
        d = (x ** 2).sum(axis=1)[:, None] + (objects ** 2).sum(axis=1) - 2 * (x @ objects.T)
        nearest = d.argmin(axis=1)
        if (np.bincount(nearest, minlength=n) == len(rows)).any():  # equal vectors: split as they lie
            nearest = np.arange(len(rows)) * n // len(rows)
        routes, radii, parents, children = [], [], [], []
        for k in range(n):
            own = rows[nearest == k]
            if len(own):
                far = np.sqrt(((self.x[own] - objects[k]) ** 2).sum(axis=1).max())
                routes.append(objects[k])
                radii.append(far)
                parents.append(0.0 if parent is None else np.sqrt(((objects[k] - parent) ** 2).sum()))
                children.append(self._load(own, objects[k]))
        self.pages[at] = (False, np.array(routes), np.array(radii), np.array(parents), np.array(children))
        return at

    def search(self, q: np.ndarray, k: int, ids: np.ndarray, own: int, bound: float):
        """(ids, scores) of the k best rows but those of id ``own``: by score, then least id.

        ``bound`` is the distance beyond which nothing is wanted. Returns also the number of
        products and distances computed. A leaf page of which more than half is left after
        the stored bounds is multiplied as it lies."""
        plain = q[:-1].astype(self.kind)
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        reach, computed = bound, 0
        queue = [(0.0, self.root, None)]
        while queue:
            least, page, d_parent = heapq.heappop(queue)
            if least > reach + SLACK:
                break
            leaf, objects, radii, to_parent, below = self.pages[page]
            if d_parent is None:
                near = np.arange(len(objects))
            else:
                near = np.flatnonzero(np.abs(to_parent - d_parent) - radii <= reach + SLACK)
                if not len(near):
                    continue
            computed += len(near)
            if leaf:
                s = objects @ plain if 2 * len(near) > len(objects) else objects[near] @ plain
                good = np.flatnonzero(s >= self.floor(best_s, k))
                if len(good):
                    rows = below[good] if len(s) == len(objects) else below[near[good]]
                    other = ids[rows] != own
                    best_s, best_i = np.concatenate((best_s, s[good][other])), np.concatenate((best_i, ids[rows][other]))
                    order = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[order], best_i[order]
                    if len(best_s) == k:
                        reach = min(reach, self.distance(q, best_s[-1]))
                continue
            d = np.sqrt(np.maximum(((objects[near] - q) ** 2).sum(axis=1), 0))
            for j, dist in zip(near.tolist(), d.tolist()):
                low = max(least, dist - radii[j])
                if low <= reach + SLACK:
                    heapq.heappush(queue, (low, int(below[j]), dist))
        return best_i, best_s, computed

    @staticmethod
    def floor(scores, k):
        return scores[-1] if len(scores) == k else -np.inf

    def distance(self, q, s):
        return np.sqrt(max(0.0, self.m2 + float(q @ q) - 2 * s))


def augmented(x: np.ndarray, m2: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(m2 - (x ** 2).sum(axis=1), 0))[:, None]), axis=1)


def _matrix(column) -> np.ndarray:
    """float64 matrix of an Arrow list<double> column."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    if n and len(flat) != n * len(column[0]):
        raise ValueError("vectors of different lengths take part")
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors that take part, as whole doubles."""
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"),
                                    F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _routed(rows: DataFrame, pivots: np.ndarray, m2: float) -> DataFrame:
    """Adds the nearest pivot of each candidate and its distance."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.mtree import _matrix, augmented
        for b in batches:
            x = augmented(_matrix(b.column(1)), m2) if b.num_rows else np.zeros((0, pivots.shape[1]))
            d = np.maximum((x ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * (x @ pivots.T), 0)
            near = d.argmin(axis=1)
            far = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int64)), pa.array(far)], names=["vec_id", "v", "region", "far"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, region long, far double")


def _visits(queries: DataFrame, pivots: np.ndarray, radii: np.ndarray, first: bool) -> DataFrame:
    """(vec_id, v, reach, region) of the regions a query visits: its nearest one; or, with the
    bound from there, all that reach inside it."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.mtree import SLACK, _matrix
        for b in batches:
            q = _matrix(b.column(1)) if b.num_rows else np.zeros((0, pivots.shape[1] - 1))
            q = np.concatenate((q, np.zeros((len(q), 1))), axis=1)
            reach = b.column(2).to_numpy(zero_copy_only=False)
            d = np.sqrt(np.maximum((q ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * (q @ pivots.T), 0))
            low = np.where(radii >= 0, d - radii, np.inf)
            if first:
                rows, region = np.arange(len(q)), np.where(radii >= 0, d, np.inf).argmin(axis=1)
            else:
                rows, region = np.nonzero((low <= reach[:, None] + 10 * SLACK) & (radii >= 0))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([c.take(at) for c in b.columns] + [pa.array(region.astype(np.int64))], names=["vec_id", "v", "reach", "region"])

    return queries.mapInArrow(run, "vec_id long, v array<double>, reach double, region long")


def _searched(blocks: DataFrame, asked: DataFrame, m2: float, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best of each block it visits."""
    def build(own):
        from kohort.llm.mtree import MTree, _matrix, augmented
        return own.column("vec_id").to_numpy(), MTree(augmented(_matrix(own.column("v")), m2), m2)

    def answer(index, part):
        import pyarrow as pa
        ids, tree = index
        q_ids, reach = part.column("vec_id").to_numpy(), part.column("reach").to_numpy()
        out = [[], [], []]
        for i, q in enumerate(_matrix(part.column("v"))):
            found, scores, _ = tree.search(np.append(q, 0.0), k, ids, q_ids[i], reach[i])
            out[0].append(np.full(len(found), q_ids[i]))
            out[1].append(found)
            out[2].append(scores.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return by_block(blocks, asked, ["region", "part"], build, answer, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, rows whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(at_most(integers(vectors, scale), k))
    result = "query_id long, rank int, vec_id long, score long"
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    m2, least, most = rows.agg(F.max(norm), F.min(F.size("v")), F.max(F.size("v"))).first()
    if m2 is None:
        return spark.createDataFrame([], result)
    if least != most or m2 >= 2.0 ** 52:
        raise ValueError(f"vectors of {least} to {most} components, largest squared norm {m2}: lengths must agree, products stay below 2^52")
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).select("v").toPandas()["v"]  # at most ``pivots`` rows
    centres = np.unique(augmented(np.array([np.array(v, float) for v in chosen]).reshape(len(chosen), -1), m2), axis=0)
    routed = cut(_routed(rows, centres, m2))
    stats = {r.region: r for r in routed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # a row a pivot
    radii = np.array([stats[i].far if i in stats else -1.0 for i in range(len(centres))])
    parts = np.array([-(-stats[i].n // block) if i in stats else 1 for i in range(len(centres))])
    n_parts = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), (F.col("region") + 1).cast("int"))
    blocks = routed.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), n_parts.cast("long"))).select("region", "part", "vec_id", "v")

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("reach", F.lit(float("inf")))
    start = F.pmod(F.xxhash64("vec_id"), n_parts.cast("long"))  # the one block searched first
    near = _visits(queries, centres, radii, True).withColumn("part", start)
    first = cut(_searched(blocks, near, m2, k))
    # the k-th score so far bounds what other regions must reach
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
    q2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    bounded = (queries.drop("reach").join(kth, F.col("vec_id") == F.col("query_id"), "left")
               .select("vec_id", "v", F.when(F.col("s").isNull(), F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(F.lit(0.0), q2 + m2 - 2 * F.col("s")))).alias("reach")))
    more = _visits(bounded, centres, radii, False).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), n_parts.cast("long") - 1)))
    seen = near.select("vec_id", "region", "part")
    rest = more.join(seen, ["vec_id", "region", "part"], "left_anti").select("vec_id", "v", "reach", "region", "part")
    found = first.unionByName(_searched(blocks, rest, m2, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
