"""Incremental line deduplication with sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of white space and with A-Z lower-cased, named by 128 bits.
A key that at least ``min_docs`` documents hold is frequent; frequent lines go from every text.

* **Reference counts** are a table (shard, hi, lo, docs): how many documents hold each key,
  exactly. Inserting documents adds their counts, deleting them subtracts; a key without
  documents leaves the table. Counts are summed in part before they are shuffled, so a line
  that a third of the documents hold costs a row a task.
* **Cuckoo filters**, one a shard of the key space, hold the frequent keys as 16-bit fingerprints
  in buckets of four. A change of the counts inserts the keys that became frequent and deletes
  those that no longer are; unlike a Bloom filter's, its deletions are exact, so a deleted batch
  leaves no trace. A filter that overflows is built anew at twice the size.
* **Judging** documents sends their keys to the shards, past the filter; what it lets through is
  confirmed in the exact counts, where the rows of a hot key are dealt over several tasks, each
  with a copy of its count. Filters are not broadcast: a shard's filter row goes ahead of
  its key rows, which stream past it; a shard with many key rows (one that holds a hot line) is
  split over as many tasks as its counted rows ask for, each with a copy of the filter.

``LineIndex`` keeps both tables as numbered versions in a shared folder, written before the new
number is handed out, so a lost job leaves the former version as it was.

Defined results: null and empty texts are one empty line; keys of fewer than ``min_chars`` code
points never go; a document is a row, so repeated rows count as often as they come, and rows
with null or repeated doc_ids are documents of their own; a line that one document repeats
counts once there and goes each time; an empty table gives an empty result; other columns are
not read. Deleting what was never inserted leaves counts below one, which count as none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kohort.llm.common import ship, slices, text_bytes

MIN_CHARS = 1
MIN_DOCS = 10
SHARD_BITS = 8
SLOTS = 4         # fingerprints a bucket
KICKS = 500       # moves before a filter counts as full
_MIX = 0x9E3779B97F4A7C15


class CuckooFilter:
    """Fingerprints of 64-bit keys: buckets[b, slot], 0 for an empty slot. A key may lie in bucket i or
    i ^ hash(fingerprint). Insertion and deletion go key by key, lookups over whole arrays."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets
        self.mask = len(buckets) - 1

    @staticmethod
    def sized(keys: int) -> "CuckooFilter":
        """An empty filter for some keys, at most 80 % full."""
        n = 1
        while n * SLOTS * 0.8 < keys:
            n *= 2
        return CuckooFilter(np.zeros((n, SLOTS), np.uint16))

    def places(self, keys: np.ndarray):
        """Fingerprint and both buckets of each key."""
        k = keys.view(np.uint64)
        with np.errstate(over="ignore"):
            k = (k ^ (k >> np.uint64(31))) * np.uint64(_MIX)
            mark = (k >> np.uint64(48)).astype(np.uint16)
            mark[mark == 0] = 1
            first = (k >> np.uint64(8)).astype(np.int64) & self.mask
        return mark, first, first ^ self._step(mark)

    def _step(self, mark):
        return (mark.astype(np.int64) * 0x5BD1E995 >> 7) & self.mask

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(keys)
        return ((self.buckets[a] == mark[:, None]) | (self.buckets[b] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds the keys; False if the filter is full, and then not to be used."""
        table = self.buckets
        for m, a, b in zip(*self.places(keys)):
            for at in (a, b):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = m
                    break
            else:
                at = int(b)
                for kick in range(KICKS):
                    slot = kick & (SLOTS - 1)
                    m, table[at, slot] = table[at, slot], m  # the one put out goes to its other bucket
                    at ^= int(self._step(np.array([m], np.uint16))[0])
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = m
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that were inserted."""
        table = self.buckets
        for m, a, b in zip(*self.places(keys)):
            for at in (a, b):
                slot = np.flatnonzero(table[at] == m)
                if len(slot):
                    table[at, slot[0]] = 0
                    break

    def body(self) -> bytes:
        return self.buckets.tobytes()

    @staticmethod
    def of(body: bytes) -> "CuckooFilter":
        return CuckooFilter(np.frombuffer(body, np.uint16).reshape(-1, SLOTS).copy())


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line, in order. bytes.strip takes off \\x20 and \\x09-\\x0D, bytes.lower A-Z."""
    return [line.strip().lower() for line in text.split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def document_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(rid, hi, lo) for the distinct keys of each row; rid is a hash of the row's doc_id and text."""
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest
        from kohort.llm.line_dedup import line_keys, long_enough
        for b in (part for batch in batches for part in slices(batch)):
            names, n = [], []
            for t in text_bytes(b, "text"):
                keys = set(line_keys(t))
                found = [xxh3_128_digest(k) for k in keys if long_enough(k, min_chars)]
                names += found
                n.append(len(found))
            both = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            rid = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            yield pa.RecordBatch.from_arrays([rid, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["rid", "hi", "lo"])

    return _named(docs).select("rid", "text").mapInArrow(run, "rid long, hi long, lo long")


def _named(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text). Rows that share a rid are judged together, which changes nothing: whether a
    line goes depends on its key alone."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.xxhash64(doc_id, F.coalesce(text, F.lit(""))).alias("rid"), doc_id.alias("doc_id"), text.alias("text"))


def _shard(bits: int):
    return F.shiftrightunsigned("hi", 64 - bits).alias("shard")


def references(docs: DataFrame, min_chars: int = MIN_CHARS, bits: int = SHARD_BITS) -> DataFrame:
    """(shard, hi, lo, docs): the number of documents that hold each key."""
    return document_keys(docs, min_chars).groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("docs")).select(_shard(bits), "hi", "lo", "docs")


def merged(refs: DataFrame, more: DataFrame, sign: int) -> DataFrame:
    """The counts with those of other documents added (sign 1) or taken off (-1)."""
    both = refs.unionByName(more.withColumn("docs", F.col("docs") * sign))
    return both.groupBy("shard", "hi", "lo").agg(F.sum("docs").alias("docs")).where("docs > 0")


def changes(refs: DataFrame, more: DataFrame, sign: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """(shard, lo, op): keys that become frequent (1) or are no longer (-1), and those that stay so (0),
    which a filter needs only if it is built anew."""
    old = refs.select("shard", "hi", "lo", F.col("docs").alias("was"), F.lit(0).cast("long").alias("d"))
    new = more.select("shard", "hi", "lo", F.lit(0).cast("long").alias("was"), (F.col("docs") * sign).alias("d"))
    both = old.unionByName(new).groupBy("shard", "hi", "lo").agg(F.sum("was").alias("was"), F.sum("d").alias("d"))
    was, now = F.col("was") >= min_docs, F.col("was") + F.col("d") >= min_docs
    return both.where(was | now).select("shard", "lo", F.when(was & now, 0).when(now, 1).otherwise(-1).cast("int").alias("op"))


def build_filters(refs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(shard, body): a filter for every shard with a frequent key."""
    return updated_filters(None, refs.where(F.col("docs") >= min_docs).select("shard", "lo", F.lit(1).cast("int").alias("op")))


def updated_filters(filters: DataFrame | None, changed: DataFrame) -> DataFrame:
    """(shard, body) after the changes (shard, lo, op)."""
    spark = changed.sparkSession
    ship(spark)
    rows = changed.select("shard", F.lit(1).alias("kind"), "lo", "op", F.lit(None).cast("binary").alias("body"))
    if filters is not None:
        rows = rows.unionByName(filters.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("lo"), F.lit(0).alias("op"), "body"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.line_dedup import CuckooFilter
        shard, body, lo, op = None, None, [], []

        def done():
            keys, ops = np.concatenate(lo), np.concatenate(op)
            f = CuckooFilter.of(body) if body is not None else None
            if f is None or not f.insert(keys[ops == 1]):
                live = keys[ops >= 0]
                f, room = CuckooFilter.sized(len(live)), max(len(live), 1)
                while not f.insert(live):
                    room *= 2
                    f = CuckooFilter.sized(room)
            else:
                f.delete(keys[ops == -1])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([f.body()], pa.binary())], names=["shard", "body"])

        for b in batches:
            s, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(s)) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(s)]):
                if x == y:
                    continue
                if shard is not None and s[x] != shard:
                    yield done()
                    body, lo, op = None, [], []
                shard = int(s[x])
                if k[x] == 0:
                    body = b.column(4)[x].as_py()
                    x += 1
                lo.append(b.column(2).to_numpy()[x:y])
                op.append(b.column(3).to_numpy()[x:y])
        if shard is not None:
            yield done()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "shard long, body binary")


def passed(keys: DataFrame, filters: DataFrame, refs: DataFrame, min_docs: int = MIN_DOCS, bits: int = SHARD_BITS) -> DataFrame:
    """The rows (rid, hi, lo) of keys that a filter holds: all frequent ones, and few others."""
    spark = keys.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a row a shard with a frequent key (at most 2 ** bits): into how many parts its key rows go, by its share of the counts
    load = refs.groupBy("shard").agg(F.sum("docs").alias("rows"), F.max("docs").alias("most"))
    load = load.withColumn("total", F.sum("rows").over(Window.partitionBy(F.lit(0)))).where(F.col("most") >= min_docs)
    load = load.select("shard", F.expr(f"CAST(1 + rows * {2 * n} div total AS INT)").alias("parts"))
    ahead = filters.join(F.broadcast(load), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), *[F.lit(0).cast("long").alias(c) for c in ("rid", "hi", "lo")], "body")
    rows = (keys.select(_shard(bits), "rid", "hi", "lo").join(F.broadcast(load), "shard")
            .select("shard", F.pmod(F.xxhash64("rid", "lo"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "rid", "hi", "lo", F.lit(None).cast("binary").alias("body")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.line_dedup import CuckooFilter
        held = None
        for b in batches:
            kind, lo = b.column(2).to_numpy(), b.column(5).to_numpy()
            marks = np.flatnonzero(kind == 0).tolist()
            for x, y in zip([-1, *marks], [*marks, len(kind)]):
                if x >= 0:
                    held = CuckooFilter.of(b.column(6)[x].as_py())
                if y > x + 1:
                    hit = pa.array(np.flatnonzero(held.holds(lo[x + 1:y])) + x + 1)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([b.column(c).take(hit) for c in (3, 4, 5)], names=["rid", "hi", "lo"])

    return (rows.unionByName(ahead).repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "kind")
            .mapInArrow(run, "rid long, hi long, lo long"))


def _judged(docs: DataFrame, refs: DataFrame, filters: DataFrame, min_chars: int, min_docs: int, bits: int, schema: str, rows) -> DataFrame:
    """The documents with the names of their lines that go; ``rows`` makes columns of (ids, texts, sets of names)."""
    asked = document_keys(docs, min_chars)
    # a key goes to as many parts as its share of the counts asks for; those of several parts are 2n at most
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = (1 + F.floor(2.0 * n * F.col("docs") / refs.agg(F.sum("docs")).scalar())).cast("int")
    frequent = refs.where(F.col("docs") >= min_docs).select("hi", "lo", parts.alias("parts"))
    hot = frequent.where(F.col("parts") > 1)
    part = F.pmod(F.xxhash64("rid", "lo"), F.coalesce("parts", F.lit(1))).cast("int")
    held = passed(asked, filters, refs, min_docs, bits).join(F.broadcast(hot), ["hi", "lo"], "left").select("rid", "hi", "lo", part.alias("part"))
    dealt = frequent.select("hi", "lo", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    gone = (held.join(dealt.hint("merge"), ["hi", "lo", "part"], "left_semi")
            .groupBy("rid").agg(F.collect_set(F.struct("hi", "lo")).alias("gone")))

    def run(batches: Iterator) -> Iterator:
        for b in (part for batch in batches for part in slices(batch)):
            lists = b.column(2)
            hi, lo = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo"))
            flat = np.stack([hi, lo], axis=1).astype(np.int64).tobytes() if len(hi) else b""
            sets, at = [], 0
            for m in lists.value_lengths().fill_null(0).to_pylist():
                sets.append({flat[i:i + 16] for i in range(16 * at, 16 * (at + m), 16)})
                at += m
            yield rows(b.column(0), text_bytes(b, "text"), sets, min_chars)

    return (_named(docs).join(gone.hint("merge"), "rid", "left").select("doc_id", "text", "gone").mapInArrow(run, schema))


def kept_lines(text: bytes, gone: set, min_chars: int) -> tuple[int, list[bytes]]:
    """(number of lines, those that stay)."""
    from xxhash import xxh3_128_digest
    lines = text.split(b"\n")
    if not gone:
        return len(lines), lines
    # a key that is too short is in no set of names
    return len(lines), [x for x, k in zip(lines, line_keys(text)) if xxh3_128_digest(k) not in gone]


def _digest_rows(ids, texts, sets, min_chars):
    from hashlib import sha256
    import pyarrow as pa
    out = []
    for t, gone in zip(texts, sets):
        n, kept = kept_lines(t, gone, min_chars)
        out.append((n, n - len(kept), sha256(b"\n".join(kept)).hexdigest()))
    cols = list(zip(*out)) or [[]] * 3
    return pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                      names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _text_rows(ids, texts, sets, min_chars):
    import pyarrow as pa
    out = [b"\n".join(kept_lines(t, gone, min_chars)[1]) for t, gone in zip(texts, sets)]
    return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])


@dataclass(frozen=True)
class LineIndex:
    """A version of the index in a shared folder. ``insert`` and ``delete`` write the next version and
    return it; the former one stays readable, so a change can also be undone by going back."""

    spark: SparkSession
    folder: str
    version: int = 0
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    bits: int = SHARD_BITS

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}-{self.version}")

    def references(self) -> DataFrame:
        return self._read("references") if self.version else self.spark.createDataFrame([], "shard long, hi long, lo long, docs long")

    def filters(self) -> DataFrame:
        return self._read("filters") if self.version else self.spark.createDataFrame([], "shard long, body binary")

    def insert(self, docs: DataFrame) -> "LineIndex":
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> "LineIndex":
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> "LineIndex":
        after = LineIndex(self.spark, self.folder, self.version + 1, self.min_chars, self.min_docs, self.bits)
        refs, at = self.references(), f"{self.folder}/%s-{after.version}"
        references(docs, self.min_chars, self.bits).write.mode("overwrite").parquet(at % "delta")
        more = self.spark.read.parquet(at % "delta")
        merged(refs, more, sign).write.mode("overwrite").parquet(at % "references")
        updated_filters(self.filters(), changes(refs, more, sign, self.min_docs)).write.mode("overwrite").parquet(at % "filters")
        return after

    def kept(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text): the documents without their frequent lines."""
        return _judged(docs, self.references(), self.filters(), self.min_chars, self.min_docs, self.bits, "doc_id long, text string", _text_rows)


def digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int = SHARD_BITS) -> DataFrame:
    """The contract's columns: doc_id, n_lines, n_dropped, kept_sha256; docs alone make the index."""
    refs = references(docs, min_chars, bits)
    return _judged(docs, refs, build_filters(refs, min_docs), min_chars, min_docs, bits, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", _digest_rows)


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS MATERIALIZED (SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
j AS (SELECT k.r, k.i, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j JOIN d ON d.r = j.r GROUP BY d.r, d.doc_id"""
