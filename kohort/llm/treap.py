"""Ranked lexical search with K2-treaps over the term-document grid.

1. Items are taken in blocks of bounded size; the distinct terms of a block are the rows of the
   grid. One pass over all documents sums what the scores need: N, L and each term's df.
2. A second pass forms the index without a shuffle: every ``DOCS`` documents of a task are the
   columns of a grid of their own, a cell (term, document) holds the term's impact there,
   ``10^9 tf div (1000 tf + 12 m)``. A grid is kept as a K2-treap: a quadtree whose levels are
   bitmaps of the non-empty quadrants (children are found by rank), every node with the largest
   impact below it, as the difference from its parent's.
3. An item descends a treap along the row paths of all its terms jointly: a state is a range of
   documents and, for each term, the node that holds the term's row and the range (or none). The
   weighted node maxima bound every score in the range. Best first: the ranges of the highest
   bounds are halved, some at a time; at single documents the bound is the score. It ends when
   no bound is left that could enter the best ``top``; a task's best go on from treap to treap.
4. The best of all tasks are ranked in two steps, so an item is no hot key.

Rows are ordered by df, so a node spans terms of like frequency and its maximum means something.

Defined results: null texts have no terms; documents without a term of the item are not ranked;
rows with null or repeated doc_ids are documents of their own, null ids last among equal
scores; rows with null or repeated item_ids are items of their own; an item without terms has
no rows; an empty table of items or documents gives an empty result; other columns are not
read. Memory follows the documents of one grid, and the longest text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kohort.llm.common import cut, ship, slices, text_bytes

TOP = 20
DOCS = 8192                # columns of a grid
ITEM_BYTES = 4 << 20       # items searched together: at most so many bytes of text, or one item
WIDTH = 64                 # document ranges that are halved at once
K1000, B100, SCALE = 12, 25, 1_000_000_000
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "qid int, doc_id long, tie long, score long"


def terms(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())


class Vocabulary:
    """The grid's rows: terms by bytes, found in many texts at once."""

    def __init__(self, rows: list[bytes]):
        from kohort.llm.words import Hasher, SEGMENT
        self.row_of = {t: i for i, t in enumerate(rows)}
        short = [(t, i) for t, i in self.row_of.items() if len(t) <= SEGMENT]
        ends = np.cumsum([0] + [len(t) for t, _ in short])
        h = np.zeros(0, np.uint64)
        for a in range(0, len(short), 256):  # the hasher's array is of bounded size
            part = short[a:a + 256]
            while part:
                n = 1
                size = len(part[0][0])
                while n < len(part) and size + len(part[n][0]) <= SEGMENT:
                    size += len(part[n][0])
                    n += 1
                cuts = np.cumsum([0] + [len(t) for t, _ in part[:n]])
                h = np.concatenate((h, Hasher(np.frombuffer(b"".join(t for t, _ in part[:n]), np.uint8))(cuts[:-1], cuts[1:])))
                part = part[n:]
        order = np.argsort(h)
        self.hashes, self.rows = h[order], np.array([i for _, i in short], np.int64)[order]
        self.sizes = np.diff(ends)[order]

    def found(self, texts: list[bytes]):
        """(number of terms of each text, text, row) of the terms that are rows, with repeats."""
        from kohort.llm.words import ALNUM, LOWER, SEGMENT, Hasher, spans
        n = np.zeros(len(texts), np.int64)
        doc, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held, size = [], 0

        def flush():
            data = LOWER[np.frombuffer(b"\n".join(texts[i] for i in held) + b"\n", np.uint8)]
            starts = np.cumsum([0] + [len(texts[i]) + 1 for i in held])[:-1]
            a, b = spans(data, ALNUM)
            of = np.array(held)[np.searchsorted(starts, a, "right") - 1]
            n[:] += np.bincount(of, minlength=len(n))
            if len(self.hashes):
                h = Hasher(data)(a, b)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = np.flatnonzero((self.hashes[at] == h) & (self.sizes[at] == b - a))
                doc.append(of[hit])
                row.append(self.rows[at[hit]])

        for i, t in enumerate(texts):
            if len(t) >= SEGMENT:  # one by one
                every = terms(t)
                n[i] = len(every)
                hit = [r for r in map(self.row_of.get, every) if r is not None]
                doc.append(np.full(len(hit), i))
                row.append(np.array(hit, np.int64))
                continue
            if held and size + len(t) >= SEGMENT:
                flush()
                held, size = [], 0
            held.append(i)
            size += len(t) + 1
        if held:
            flush()
        return n, np.concatenate(doc), np.concatenate(row)


class Treap:
    """A K2-treap of cells (row, column) with positive values. Level 0 is the root; at level l a node
    covers side >> l rows and columns. Per level: a bit for each of the four quadrants of every
    node, the number of bits set ahead of each node, and the maxima as differences."""

    def __init__(self, side_bits: int, bits: list, ahead: list, drop: list):
        self.side_bits, self.bits, self.ahead, self.drop = side_bits, bits, ahead, drop

    @staticmethod
    def of(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, side_bits: int) -> "Treap":
        code = np.zeros(len(rows), np.int64)
        for b in range(side_bits):  # quadrant of each level: row half, column half
            code |= (rows >> b & 1) << (2 * b + 1) | (cols >> b & 1) << (2 * b)
        order = np.argsort(code)
        code, best = code[order], values[order]
        levels = [(code, best)]
        for _ in range(side_bits):
            up = code >> 2
            first = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
            code, best = up[first], np.maximum.reduceat(best, first)
            levels.append((code, best))
        levels.reverse()
        bits, ahead, drop = [], [], [levels[0][1].astype(np.int32)]
        for (c0, v0), (c1, v1) in zip(levels, levels[1:]):
            parent = np.searchsorted(c0, c1 >> 2)
            mask = np.zeros(4 * len(c0), bool)
            mask[4 * parent + (c1 & 3)] = True
            bits.append(np.packbits(mask, bitorder="little"))
            ahead.append(np.searchsorted(parent, np.arange(len(c0))).astype(np.int32))
            drop.append((v0[parent] - v1).astype(np.int32))
        return Treap(side_bits, bits, ahead, drop)

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The node at the next level in a quadrant of each node; -1 for none, also below -1."""
        at = np.maximum(node, 0)
        four = self.bits[level][at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15
        q = quadrant.astype(np.uint8)
        there = (four >> q & 1).astype(bool) & (node >= 0)
        below = _ONES[four & ((1 << q) - 1).astype(np.uint8)]
        return np.where(there, self.ahead[level][at] + below, -1)

    def body(self) -> bytes:
        import pyarrow as pa
        parts = [np.array([self.side_bits], np.int32), *(x for y in zip(self.bits, self.ahead, self.drop[1:]) for x in y), self.drop[0]]
        table = pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary())], names=["p"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(table)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def read(body: bytes) -> "Treap":
        import pyarrow as pa
        (table,) = pa.ipc.open_stream(body)
        parts = table.column(0).to_pylist()
        side_bits = int(np.frombuffer(parts[0], np.int32)[0])
        bits = [np.frombuffer(p, np.uint8) for p in parts[1:-1:3]]
        ahead = [np.frombuffer(p, np.int32) for p in parts[2:-1:3]]
        drop = [np.frombuffer(p, np.int32) for p in [parts[-1], *parts[3:-1:3]]]
        return Treap(side_bits, bits, ahead, drop)


_ONES = np.array([bin(x).count("1") for x in range(16)], np.int64)


class Best:
    """The best documents of an item so far, as (-score, tie, doc_id): lower is better."""

    def __init__(self, top: int):
        self.top, self.held = top, []

    def least(self) -> int:
        """Scores below this cannot enter; equal ones can, by their ids."""
        return -self.held[-1][0] if len(self.held) == self.top else 1

    def add(self, found: list) -> None:
        self.held = sorted(self.held + found)[:self.top]


def search(treap: Treap, n_docs: int, rows: np.ndarray, weights: np.ndarray, best: Best, keys) -> int:
    """Best-first descent for one item: distinct rows and their weights. ``keys(columns)`` names the
    documents. Returns the number of ranges met."""
    if not len(treap.drop[0]) or not len(rows):
        return 0
    t = len(rows)
    # frontier: bound, level, first column, and the nodes and maxima of the terms
    bound = np.array([int(weights.sum()) * int(treap.drop[0][0])])
    level, col = np.zeros(1, np.int64), np.zeros(1, np.int64)
    node, most = np.zeros((1, t), np.int64), np.full((1, t), int(treap.drop[0][0]), np.int64)
    met = 0
    while len(bound):
        pick = np.argpartition(-bound, WIDTH)[:WIDTH] if len(bound) > WIDTH else np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[pick] = False
        made = []
        for l in np.unique(level[pick]).tolist():
            own = pick[level[pick] == l]
            half = treap.side_bits - 1 - l
            for side in (0, 1):
                c = col[own] + (side << half)
                if side and c.min() >= n_docs:
                    continue
                q = np.broadcast_to(((rows >> half & 1) << 1 | side)[None, :], (len(own), t))
                child = treap.child(l, node[own], q)
                value = np.where(child >= 0, most[own] - treap.drop[l + 1][np.maximum(child, 0)], 0)
                b = value @ weights
                met += len(b)
                if half == 0:
                    hit = np.flatnonzero(b >= best.least())
                    if len(hit):
                        best.add([(-s, *k) for s, k in zip(b[hit].tolist(), keys(c[hit]))])
                else:
                    keep = np.flatnonzero(b > 0)
                    made.append((b[keep], np.full(len(keep), l + 1), c[keep], child[keep], value[keep]))
        old = (bound, level, col, node, most)
        bound, level, col, node, most = (np.concatenate([x[rest], *(m[k] for m in made)]) for k, x in enumerate(old))
        live = bound >= best.least()
        if not live.all():
            bound, level, col, node, most = (x[live] for x in (bound, level, col, node, most))
    return met


def item_blocks(items: DataFrame, most_bytes: int = ITEM_BYTES) -> Iterator:
    """Lists of (item_id, {term: times}) in blocks of bounded size; one block is held at a time."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        counts: dict[bytes, int] = {}
        for t in terms((r.text or "").encode()):
            counts[t] = counts.get(t, 0) + 1
        if held and size + len(r.text or "") > most_bytes:
            yield held
            held, size = [], 0
        held.append((r.item_id, counts))
        size += len(r.text or "")
    if held:
        yield held


def _columns(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def statistics(docs: DataFrame, rows: list[bytes]) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each row); the driver gets a number a row."""
    spark, n_rows = docs.sparkSession, len(rows)
    sent = spark.sparkContext.broadcast(rows)  # of a block of items, bounded by its bytes

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.treap import Vocabulary
        v = Vocabulary(sent.value)
        sums = np.zeros(n_rows + 2, np.int64)
        for b in (part for batch in batches for part in slices(batch)):
            n, doc, row = v.found(text_bytes(b, "text"))
            one = np.unique(doc * max(n_rows, 1) + row) % max(n_rows, 1)
            sums[:n_rows] += np.bincount(one, minlength=n_rows)
            sums[n_rows:] += (int((n > 0).sum()), int(n.sum()))
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(sums[hit])], names=["row", "n"])

    got = np.zeros(n_rows + 2, np.int64)
    for r in _columns(docs).mapInArrow(run, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).collect():
        got[r.row] = r.n
    return int(got[n_rows]), int(got[n_rows + 1]), got[:n_rows]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def index(docs: DataFrame, rows: list[bytes], n_all: int, l_all: int, docs_a_grid: int = DOCS) -> DataFrame:
    """(doc_ids, named, body): the grids of all documents with a term among the rows, as K2-treaps."""
    sent = docs.sparkSession.sparkContext.broadcast(rows)  # of a block of items, bounded by its bytes
    row_bits = max(len(rows) - 1, 1).bit_length()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm import treap
        v = treap.Vocabulary(sent.value)
        ids, cells, n_held = [], [], 0

        def grid():
            doc, row, tf, m = (np.concatenate(c) for c in zip(*cells))
            impact = (SCALE * tf) // (1000 * tf + K1000 * m)
            bits = max(row_bits, (n_held - 1).bit_length(), 1)
            body = treap.Treap.of(row, doc, impact, bits).body()
            every = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([pa.array([every.fill_null(0).to_numpy()], pa.list_(pa.int64())), pa.array([every.is_valid().to_numpy(zero_copy_only=False)], pa.list_(pa.bool_())),
                                               pa.array([body], pa.binary())], names=["doc_ids", "named", "body"])

        for b in (part for batch in batches for part in slices(batch)):
            n, doc, row = v.found(text_bytes(b, "text"))
            key, tf = np.unique(doc * max(len(sent.value), 1) + row, return_counts=True)
            doc, row = key // max(len(sent.value), 1), key % max(len(sent.value), 1)
            hit = np.unique(doc)  # documents without a row's term are no columns
            if not len(hit):
                continue
            m = 100 - B100 + (B100 * n * n_all) // max(l_all, 1)
            ids.append(b.column(0).take(pa.array(hit)))
            cells.append((np.searchsorted(hit, doc) + n_held, row, tf, m[doc]))
            n_held += len(hit)
            if n_held + 512 > docs_a_grid:
                yield grid()
                ids, cells, n_held = [], [], 0
        if n_held:
            yield grid()

    return _columns(docs).mapInArrow(run, "doc_ids array<long>, named array<boolean>, body binary")


def _searched(grids: DataFrame, queries: list, top: int) -> DataFrame:
    """(qid, doc_id, tie, score): the best documents of every task for every item (rows, weights)."""
    sent = grids.sparkSession.sparkContext.broadcast(queries)  # of a block of items, bounded by its bytes

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm import treap
        best = [treap.Best(top) for _ in sent.value]
        for b in batches:
            for k in range(b.num_rows):
                ids, named = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (0, 1))
                t = treap.Treap.read(b.column(2)[k].as_py())

                def keys(cols):
                    return zip((~named[cols]).astype(int).tolist(), ids[cols].tolist())

                for q, (rows, weights) in enumerate(sent.value):
                    treap.search(t, len(ids), rows, weights, best[q], keys)
        out = [(q, i if not tie else None, tie, -s) for q, x in enumerate(best) for s, tie, i in x.held]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["qid", "doc_id", "tie", "score"])

    return grids.mapInArrow(run, SCHEMA)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of all tasks' best, by parts first."""
    order = [F.col("score").desc(), F.col("tie"), F.col("doc_id")]
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = found.withColumn("part", F.spark_partition_id() % n)
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= top)


def top_documents(docs: DataFrame, items: DataFrame, top: int = TOP, docs_a_grid: int = DOCS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The contract's columns: item_id, rank, doc_id, score."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    out = []
    for block in item_blocks(items, item_bytes):
        rows = sorted({t for _, counts in block for t in counts})
        n_all, l_all, df = statistics(docs, rows)
        order = np.argsort(-df, kind="stable")
        rows, df = [rows[i] for i in order.tolist()], df[order]
        row_of = {t: i for i, t in enumerate(rows)}
        w = [weight(n_all, int(x)) for x in df.tolist()]
        # terms that no document holds, or that weigh nothing, add nothing
        queries = []
        for _, counts in block:
            own = sorted((row_of[t], times) for t, times in counts.items() if df[row_of[t]] and w[row_of[t]])
            queries.append((np.array([r for r, _ in own], np.int64), np.array([w[r] * times for r, times in own], np.int64)))
        ranked = _ranked(_searched(index(docs, rows, n_all, l_all, docs_a_grid), queries, top), top)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "qid int, item_id long")
        out.append(ranked.join(F.broadcast(names), "qid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))  # a block of items, bounded
        if len(out) > 1:  # with several blocks of items, each is done before the next is held
            out[-2:] = [cut(x) for x in out[-2:]] if len(out) == 2 else [out[-2], cut(out[-1])]
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
s AS MATERIALIZED (SELECT count(*)::BIGINT AS n_all, sum(len(terms))::BIGINT AS l_all FROM d WHERE len(terms) > 0),
asked AS MATERIALIZED (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
tf AS MATERIALIZED (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_all),
m AS MATERIALIZED (SELECT r, doc_id, 100 - 25 + ((25 * len(terms) * n_all) // l_all) AS m FROM d, s WHERE len(terms) > 0),
scored AS (SELECT a.q, a.item_id, m.r, m.doc_id, sum(a.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m)))::BIGINT AS score
           FROM asked a JOIN w ON w.term = a.term JOIN tf ON tf.term = a.term JOIN m ON m.r = tf.r GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
