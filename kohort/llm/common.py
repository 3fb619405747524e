"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.session import checkpoint_dir, ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batch, rows: int = 512):
    """An Arrow batch in parts, so that few texts are held as Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_bytes(batch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column of an Arrow batch; null becomes empty."""
    import pyarrow as pa
    return [b if b is not None else b"" for b in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()]


def at_most(rows: DataFrame, k: int) -> DataFrame:
    """The rows, equal ones at most ``k`` times: a search for the k best needs no more of them. They
    are counted before the shuffle, so a row that is a third of the table is no hot key."""
    n = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*rows.columns, F.explode(F.array_repeat(F.lit(0), F.least("n", F.lit(k)).cast("int"))).alias("copy")).drop("copy")


def by_block(rows: DataFrame, asked: DataFrame, keys: list[str], build: Callable, answer: Callable, schema: str) -> DataFrame:
    """``answer(build(rows of a block), some of its queries)`` for the blocks that both sides name.

    rows has the whole number columns ``keys``, vec_id and v; asked has reach (double) too. The
    rows of a block meet in one task and are built into an index once; its queries follow them a batch at a
    time, so a task holds one block and one batch. ``build`` takes an Arrow table (vec_id, v), ``answer``
    an index and a record batch (vec_id, v, reach), and gives a record batch of ``schema``."""
    both = (rows.select(*keys, F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("reach"))
            .unionByName(asked.select(*keys, F.lit(1).alias("kind"), "vec_id", "v", "reach")))
    n = len(keys) + 1

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        block, own, index = None, [], None
        for b in (b for b in batches if b.num_rows):
            k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n)])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                part = b.slice(at, end - at).select(["vec_id", "v", "reach"])
                if block != tuple(k[:-1, at]):
                    block, own, index = tuple(k[:-1, at]), [], None
                if not k[-1, at]:
                    own.append(part)
                elif own:
                    index = build(pa.Table.from_batches(own)) if index is None else index
                    yield answer(index, part)

    return both.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge table (a long, b long): rows (node, root).

    root is the smallest node of the component. Alternating large-star and small-star
    steps; each is one aggregation and one join on the node (skewed hubs are split by the
    adaptive join), and its result is checkpointed, so a lost executor costs one step.
    Nodes without an edge are absent. An empty edge table gives an empty result.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        # large star: link every larger neighbour of u to the smallest of u and its neighbours
        sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: link u and its smaller neighbours to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        edges = cut(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
