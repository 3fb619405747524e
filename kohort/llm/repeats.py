"""Suffix-array deduplication: maximal repeats of at least ``LENGTH`` bytes, all occurrences.

A suffix array of the whole corpus cannot be built in one place, and need not be. Each window
of LENGTH bytes is filed under its anchor, the 32-byte string in it with the smallest hash, so
equal windows meet under one anchor; consecutive windows with the same anchor occurrence form
a block of some 250 bytes. Then

1. anchors are counted (partial sums first), blocks with an anchor met once are dropped;
2. equal blocks collapse to one with a count (a passage that a third of the documents share
   costs one row a task); equal blocks are a repeat group as they stand;
3. the texts of the distinct blocks of an anchor are fetched once and sorted into an enhanced
   suffix array; a stack scan over its LCPs walks the interval tree, intervals whose
   occurrences have different left neighbours are the maximal repeat groups, with all their
   occurrences. Anchors are independent, so tasks sort many small arrays;
4. an anchor with more than ``HOT`` distinct blocks is not sorted in one task: its windows are
   parted into bins of 16 by their distance from the anchor, and filed under the hash of the
   185 bytes that all windows of the bin hold, which equal windows share. Most stand alone and
   go; the rest is sorted as before. Only where more than HOT meet again (the very edge of a
   passage that very many documents share) windows are compared by 64-bit digests beside the
   64 bits of their core, counted with partial sums; the same answer without a big group;
5. the ranges go back to the documents that hold the blocks, a list a block.

Equal rows collapse to one with a count before anything else; where it is above one, all of a text
of LENGTH bytes or more goes without a search.

Groups are maximal inside a block: the first window of a block counts as having a neighbour
of its own, and a repeat that is longer than a block appears as one group per block, whose
occurrences overlap. The bytes covered are exactly those of all repeated windows.

Texts move once, packed by zlib. Nothing is collected, broadcast, capped or cross joined.

Defined results: null texts are empty; texts shorter than LENGTH have no windows; every row is a
document, repeated rows are occurrences of each other, each row is returned; null doc_ids
take part; an empty table gives an empty result; other columns are only carried by
``without_repeats`` (and must be of types that Spark can hash).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.llm.common import ship

LENGTH = 200
HOT = 512
BIN = 16
SORT_WINDOWS = 12_000  # windows sorted at once


def keyed(docs: DataFrame) -> DataFrame:
    """(did, th, row, text): a hash of the whole row, its columns but the text, and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = [c for c in docs.columns if c != "text"]
    # nulls, which the hash skips, are told by their places
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("did"),
                       F.xxhash64(text, *others, *[F.col(c).isNull() for c in others]).alias("th"), F.struct(*others).alias("row"), text.alias("text"))


def _bytes(column) -> list[bytes]:
    import pyarrow as pa
    return column.cast(pa.large_binary()).to_pylist()


def _longs(*names: str) -> T.StructType:
    """Long columns without nulls. Joins then need no null filters, so all uses of an exchange
    have the same plan below them and Spark runs it once."""
    return T.StructType([T.StructField(n, T.LongType(), False) for n in names])


def block_rows(texts: DataFrame, length: int) -> DataFrame:
    """(did, th, place, mh, sh, copies): place is start << 20 | distance of the anchor << 8 | windows; mh and
    sh hash anchor and content."""
    def run(batches: Iterator) -> Iterator:
        import zlib
        import numpy as np
        import pyarrow as pa
        from kohort.llm.repeats_kernel import blocks
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                text, start, windows, anchor, mh, sh = blocks([zlib.decompress(z) for z in part.column(3).to_pylist()], length)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(start << 20 | anchor << 8 | windows),
                                                  pa.array(mh.view(np.int64)), pa.array(sh.view(np.int64)), part.column(4).take(rows)], names=["did", "th", "place", "mh", "sh", "copies"])

    return texts.select("did", "th", "row", "z", "copies").mapInArrow(run, _longs("did", "th", "place", "mh", "sh", "copies"))


def packed(docs: DataFrame) -> DataFrame:
    """(did, th, row, z, copies): the distinct rows, texts packed for the shuffle. Every use reads all
    columns, so all share one exchange."""
    def run(batches: Iterator) -> Iterator:
        import zlib
        import pyarrow as pa
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([zlib.compress(t, 1) for t in _bytes(part.column(3))], pa.binary())],
                                                 names=["did", "th", "row", "z"])

    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields[:3], T.StructField("z", T.BinaryType())]))
    one = rows.groupBy(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("did", "th")])
    return one.agg(F.first("row").alias("row"), F.first("z").alias("z"), F.count(F.lit(1)).alias("copies"))


def _fetched(blocks: DataFrame, texts: DataFrame, length: int, bins: bool) -> DataFrame:
    """The texts of blocks (mk, sh, rep), to be sorted by key: (key, mk, sh, off, windows, data). The key is the
    anchor; or, with ``bins``, a block comes as its bins, each under the hash of its core."""
    wanted = blocks.groupBy(F.col("rep.did").alias("did"), F.col("rep.th").alias("th")).agg(F.collect_list(F.struct("rep.place", "mk", "sh", "n")).alias("picks"))

    def run(batches: Iterator) -> Iterator:
        import zlib
        from hashlib import blake2b
        import numpy as np
        import pyarrow as pa
        from kohort.llm.repeats import BIN
        names = ["key", "mk", "sh", "off", "windows", "data"]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                picks = part.column(0)
                n = picks.value_lengths().to_numpy()
                flat = picks.flatten()
                place = flat.field("place").to_numpy()
                start, anchor, windows = place >> 20, place >> 8 & 0xFFF, place & 0xFF
                data, k = [], 0
                for z, m in zip(part.column(1).to_pylist(), n.tolist()):
                    t = zlib.decompress(z)
                    for i in range(k, k + m):
                        data.append(t[start[i]:start[i] + windows[i] + length - 1])
                    k += m
                mk, sh = flat.field("mk"), flat.field("sh")
                if not bins:
                    yield pa.RecordBatch.from_arrays([mk, mk, sh, pa.array(np.zeros(len(data), np.int64)), pa.array(windows), pa.array(data, pa.binary())], names=names)
                    continue
                rows, key, off, count, cut = [], [], [], [], []
                for i, (d, a, w) in enumerate(zip(data, anchor.tolist(), windows.tolist())):
                    for g in range(max(0, a - w + 1) // BIN, a // BIN + 1):  # windows begin g * BIN .. g * BIN + BIN - 1 before the anchor
                        core = a - g * BIN
                        first, last = max(0, core - BIN + 1), min(w - 1, core)
                        rows.append(i)
                        key.append(int.from_bytes(blake2b(d[core:core + length - BIN + 1], digest_size=8, salt=g.to_bytes(2, "little")).digest(), "little", signed=True))
                        off.append(first)
                        count.append(last - first + 1)
                        cut.append(d[first:last + length])
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), mk.take(rows), sh.take(rows), pa.array(off, pa.int64()), pa.array(count, pa.int64()), pa.array(cut, pa.binary())], names=names)

    # row and copies go along so that this exchange of the texts is the one that the last join uses
    return wanted.hint("merge").join(texts, ["did", "th"]).select("picks", "z", "row", "copies").mapInArrow(run, _longs("key", "mk", "sh", "off", "windows").add("data", T.BinaryType(), False))


def _counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with the number of rows of its keys, for those with several. Both sides of the join are dealt
    out for it alone (by keys of its own), so hot keys may be split."""
    own = [F.col(k).bitwiseXOR(F.lit(1).cast("long")).alias(f"_{k}") for k in keys]
    names = [f"_{k}" for k in keys]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1).select(*own, name)
    return df.select("*", *own).join(counts.hint("merge"), names).drop(*names)


def _digests(fetched: DataFrame, length: int) -> DataFrame:
    """(key, mk, sh, off, digest) of every window."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from kohort.llm.words import Hasher
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                data, w = part.column(5).to_pylist(), part.column(4).to_numpy()
                base = np.cumsum([0] + [len(d) for d in data])[:-1]
                step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                a = np.repeat(base, w) + step
                h = Hasher(np.frombuffer(b"".join(data), np.uint8))(a, a + length)
                rows = pa.array(np.repeat(np.arange(len(data)), w))
                off = np.repeat(part.column(3).to_numpy(), w) + step
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in range(3)), pa.array(off), pa.array(h.view(np.int64))], names=["key", "mk", "sh", "off", "digest"])

    return fetched.select("key", "mk", "sh", "off", "windows", "data").mapInArrow(run, _longs("key", "mk", "sh", "off", "digest"))


def _by_key(batches: Iterator, most: int) -> Iterator:
    """Lists (mk, sh, off, windows, data) of whole keys, of about ``most`` windows; the rows come sorted by key."""
    import numpy as np
    held, n = [], 0

    def lists(rows):
        cols = list(zip(*rows))
        return [np.array(c) for c in cols[1:5]] + [list(cols[5])]

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if n >= most and row[0] != held[-1][0]:
                yield lists(held)
                held, n = [], 0
            held.append(row)
            n += row[4]
    if held:
        yield lists(held)


def _sorted_ranges(fetched: DataFrame, length: int) -> DataFrame:
    """(mk, sh, ranges): what maximal repeats cover of each block, as (first, end) of its bytes."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from kohort.llm.repeats import SORT_WINDOWS, _by_key
        from kohort.llm.repeats_kernel import EnhancedSuffixArray
        for mk, sh, off, windows, data in _by_key(batches, SORT_WINDOWS):
            block, first, end = EnhancedSuffixArray(data, windows, length).covered()
            if not len(block):
                continue
            hit, n = np.unique(block, return_counts=True)
            ranges = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)),
                                              pa.StructArray.from_arrays([pa.array(first + off[block]), pa.array(end + off[block])], names=["first", "end"]))
            yield pa.RecordBatch.from_arrays([pa.array(mk[hit]), pa.array(sh[hit]), ranges], names=["mk", "sh", "ranges"])

    n = int(fetched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (fetched.repartition(n, "key").sortWithinPartitions("key", "mk", "sh")
            .mapInArrow(run, _longs("mk", "sh").add("ranges", T.ArrayType(_longs("first", "end"), False), False)))


def _met(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(all blocks whose anchor is met again, as (did, th, place, copies, mk, sh); the distinct ones (mk, sh, n, rep))."""
    rows = block_rows(texts, length).withColumn("mk", F.col("mh").bitwiseXOR(F.lit(1).cast("long")))
    met = rows.groupBy("mh").agg(F.sum("copies").alias("n")).where("n > 1").select(F.col("mh").bitwiseXOR(F.lit(1).cast("long")).alias("mk"))
    # both sides are dealt out by mk for this join alone, so it may split hot anchors; what follows
    # is dealt out anew, by a key of another name
    cand = rows.join(met.hint("merge"), "mk").select("did", "th", "place", "copies", F.col("mh").alias("mk"), "sh")
    return cand, cand.groupBy("mk", "sh").agg(F.sum("copies").alias("n"), F.min(F.struct("did", "th", "place")).alias("rep"))


def _joined_windows(length: int):
    """The ranges that windows at the sorted offsets ``o`` cover, as (first, end)."""
    breaks = f"filter(sequence(0, size(o) - 1), i -> i = 0 OR o[i] - o[greatest(i - 1, 0)] > {length})"
    return F.expr(f"transform({breaks}, (i, j) -> named_struct('first', o[i], 'end', {length} + "
                  f"o[CASE WHEN j + 1 < size({breaks}) THEN element_at({breaks}, j + 2) - 1 ELSE size(o) - 1 END]))")


def repeated_ranges(texts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(did, th, found) of the documents with repeated windows; found has the start and the ranges, as (first,
    end) from there, of every block; ranges may overlap."""
    cand, distinct = _met(texts, length)
    # equal blocks: a repeat group as they stand
    whole = distinct.where("n > 1").select("mk", "sh", F.array(F.struct(F.lit(0).cast("long").alias("first"),
                                                                       F.expr(f"(rep.place & 255) + {length - 1}").alias("end"))).alias("ranges"))
    # n and rep are read in every branch, for the same reason as in _longs
    own = F.col("mk").bitwiseXOR(F.lit(1).cast("long"))
    per = distinct.groupBy("mk").agg(F.count("rep.place").alias("d"), F.sum("n").alias("total")).where("total > 1").select(own.alias("_k"), "d")
    distinct = distinct.withColumn("_k", own).join(per.hint("merge"), "_k").drop("_k")
    some = _sorted_ranges(_fetched(distinct.where((F.col("d") > 1) & (F.col("d") <= hot)), texts, length, False), length)
    # anchors with many different blocks: by the cores of their bins
    bins = _counted(_fetched(distinct.where(F.col("d") > hot), texts, length, True), ["key"], "met")
    parted = _sorted_ranges(bins.where(F.col("met") <= hot).drop("met"), length)
    # cores with many different edges: windows by digest
    again = _counted(_digests(bins.where(F.col("met") > hot), length), ["key", "digest"], "n")
    many = again.groupBy("mk", "sh").agg(F.sort_array(F.collect_list("off")).alias("o")).select("mk", "sh", _joined_windows(length).alias("ranges"))
    found = whole.unionByName(some).unionByName(parted).unionByName(many)
    at = cand.join(found.hint("merge"), ["mk", "sh"]).select("did", "th", F.struct(F.shiftright("place", 20).alias("start"), "ranges").alias("f"))
    return at.groupBy("did", "th").agg(F.collect_list("f").alias("found"))


def _strings(blocks: DataFrame, length: int, longer: bool) -> DataFrame:
    """The strings of blocks (mk, sh, data, offs) that begin at offs, of ``length`` bytes or, if ``longer``,
    of all sizes from there to the block's end: (mk, sh, off, size, digest, left, next); left is
    256 at a block's first window, next is -1 at its end."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from kohort.llm.words import Hasher
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                data = part.column(2).to_pylist()
                n = part.column(3).value_lengths().to_numpy()
                ends = np.cumsum([len(d) for d in data])
                flat = np.frombuffer(b"".join(data) + b"\0", np.uint8)
                row = np.repeat(np.arange(len(data)), n)
                off = part.column(3).flatten().to_numpy()
                base = (ends - [len(d) for d in data])[row]
                sizes = ends[row] - base - off - length + 1 if longer else np.ones(len(row), np.int64)
                more = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                row, off, base = np.repeat(row, sizes), np.repeat(off, sizes), np.repeat(base, sizes)
                first = base + off
                end = first + length + more
                left = np.where(off > 0, flat[first - 1].astype(np.int64), 256)
                after = np.where(end < ends[row], flat[end].astype(np.int64), -1)
                digest = Hasher(flat)(first, end).view(np.int64)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *map(pa.array, (off, length + more, digest, left, after))],
                                                 names=["mk", "sh", "off", "size", "digest", "left", "next"])

    return blocks.select("mk", "sh", "data", "offs").mapInArrow(run, _longs("mk", "sh", "off", "size", "digest", "left", "next"))


def _hot_groups(fetched: DataFrame, length: int) -> DataFrame:
    """(mk, group, size, sh, off): the maximal repeats of every anchor's blocks, as its enhanced suffix
    array has them, by counts. A string of two blocks or more is an LCP interval if what follows
    it differs or it ends a block, and maximal if what precedes it differs or it begins a block.
    A string whose first window is preceded by one byte alone is not maximal, however long it is,
    so only the windows that pass go on to strings of all sizes."""
    own = F.col("digest").bitwiseXOR(F.lit(1).cast("long")).alias("_k")  # dealt out for one join alone, as in _counted
    diverse = "n > 1 AND (l0 < l1 OR l1 = 256)"
    counts = [F.count(F.lit(1)).alias("n"), F.min("left").alias("l0"), F.max("left").alias("l1"), F.min("next").alias("x0"), F.max("next").alias("x1")]

    def members(strings: DataFrame, which: str) -> DataFrame:
        good = strings.groupBy("mk", "size", "digest").agg(*counts).where(which).select("mk", "size", own)
        return strings.withColumn("_k", own).join(good.hint("merge"), ["mk", "size", "_k"]).select("mk", "sh", "off", "size", "digest")

    whole = fetched.withColumn("offs", F.expr("sequence(0L, windows - 1)"))
    begins = members(_strings(whole, length, False), diverse).groupBy("mk", "sh").agg(F.collect_list("off").alias("offs"))
    strings = _strings(fetched.select("mk", "sh", "data").join(begins.hint("merge"), ["mk", "sh"]), length, True)
    found = members(strings, f"({diverse}) AND (x0 < x1 OR x0 = -1)")
    return found.select("mk", F.concat_ws(":", F.lit("string"), "size", "digest").alias("group"), "size", "sh", "off")


def repeat_groups(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Every maximal repeat group with all its occurrences: rows (anchor, group, size, did, th, start, copies);
    (anchor, group) names the group, size is its length in bytes, did is the doc_id and th a hash of
    the row, which occurs ``copies`` times. A group of equal blocks has the
    block's whole length. Under anchors of more than ``hot`` distinct blocks, which no task sorts,
    the same groups are found by digests."""
    ship(docs.sparkSession)
    texts = packed(keyed(docs))
    cand, distinct = _met(texts, length)
    whole = distinct.where("n > 1").select("mk", F.concat_ws(":", F.lit("block"), "sh").alias("group"),
                                           F.expr(f"(rep.place & 255) + {length - 1}").alias("size"), "sh", F.lit(0).cast("long").alias("off"))
    counted = _counted(distinct, ["mk"], "d")
    equal = _hot_groups(_fetched(counted.where(F.col("d") > hot), texts, length, False), length)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from kohort.llm.repeats import _by_key
        from kohort.llm.repeats_kernel import EnhancedSuffixArray
        for mk, sh, _, windows, data in _by_key(batches, 1):
            sa = EnhancedSuffixArray(data, windows, length)
            for k, (size, a, b) in enumerate(sa.maximal_repeats().tolist()):
                hit = sa.order[a:b + 1]
                at = sa.block[hit]
                yield pa.RecordBatch.from_arrays([pa.array(mk[at]), pa.array([str(k)] * len(hit)), pa.array(np.full(len(hit), size)),
                                                  pa.array(sh[at]), pa.array(sa.offset[hit])], names=["mk", "group", "size", "sh", "off"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (_fetched(counted.where(F.col("d") <= hot), texts, length, False).repartition(n, "key").sortWithinPartitions("key", "sh")
             .mapInArrow(run, "mk long, group string, size long, sh long, off long"))
    at = (found.unionByName(whole).unionByName(equal).join(cand.drop("copies").hint("merge"), ["mk", "sh"])
          .select(F.col("mk").alias("anchor"), "group", "size", "did", "th", (F.shiftright("place", 20) + F.col("off")).alias("start")))
    ids = texts.select("did", "th", F.col("row.doc_id").cast("long").alias("doc_id"), "copies")
    return at.join(ids.hint("merge"), ["did", "th"]).select("anchor", "group", "size", F.col("doc_id").alias("did"), "th", "start", "copies")


def _cut_ranges(column, copies: int, i: int, size: int, length: int):
    """Merged (first, end) arrays of what goes of a text of ``size`` bytes: all of it if its row is repeated,
    else the ranges in row i of a list<struct<start, ranges>> column."""
    import numpy as np
    from kohort.llm.repeats_kernel import merged
    if copies > 1 and size >= length:
        return np.array([0]), np.array([size])
    v = column[i]
    if not v.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranges = v.values.field("ranges")
    start = np.repeat(v.values.field("start").to_numpy(), ranges.value_lengths().to_numpy())
    flat = ranges.flatten()
    return merged(start + flat.field("first").to_numpy(), start + flat.field("end").to_numpy())


def _joined(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """(row, z, found, copies) of every distinct row."""
    ship(docs.sparkSession)
    texts = packed(keyed(docs))
    return texts.join(repeated_ranges(texts, length, hot), ["did", "th"], "left").select("row", "z", "found", "copies")


def _each(df: DataFrame, cols: list) -> DataFrame:
    """Each row as often as its row was there."""
    return df.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copies")).drop("copies")


def digest(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    def run(batches: Iterator) -> Iterator:
        import zlib
        from hashlib import sha256
        import pyarrow as pa
        from kohort.llm.repeats import _cut_ranges
        for b in batches:
            out = []
            for i, z in enumerate(b.column(1).to_pylist()):
                t = zlib.decompress(z)
                first, end = _cut_ranges(b.column(2), b.column(3)[i].as_py(), i, len(t), length)
                kept = sha256()
                at = 0
                for a, e in zip(first.tolist(), end.tolist()):
                    kept.update(t[at:a])
                    at = e
                kept.update(t[at:])
                out.append((len(t), int((end - first).sum()), len(first), kept.hexdigest()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).field(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), b.column(3)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "copies"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _joined(docs, length, hot).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, copies long")
    return _each(out, out.columns[:-1])


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The documents without the repeated bytes, with docs' columns; n_chars follows the text. Cut
    bytes may split a character: what is left of it becomes U+FFFD. Every document stays, with an
    empty text if all of it was repeated; documents without a repeated byte stay as they are."""
    cols = docs.columns

    def run(batches: Iterator) -> Iterator:
        import zlib
        import pyarrow as pa
        from kohort.llm.repeats import _cut_ranges
        for b in batches:
            texts, cut = [], []
            for i, z in enumerate(b.column(1).to_pylist()):
                t = zlib.decompress(z)
                first, end = _cut_ranges(b.column(2), b.column(3)[i].as_py(), i, len(t), length)
                parts, at = [], 0
                for a, e in zip(first.tolist(), end.tolist()):
                    parts.append(t[at:a])
                    at = e
                cut.append(len(first) > 0)
                texts.append((b"".join(parts) + t[at:]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(cut, pa.bool_()), b.column(3)], names=["row", "new_text", "cut", "copies"])

    joined = _joined(docs, length, hot)
    out = joined.mapInArrow(run, T.StructType([joined.schema["row"], T.StructField("new_text", T.StringType()), T.StructField("cut", T.BooleanType()), T.StructField("copies", T.LongType())]))
    count = F.when(F.col("cut"), F.length("new_text").cast("long"))
    named = {c: F.col("row")[c] for c in cols if c != "text"} | {"text": F.col("new_text")}
    if "n_chars" in named:
        named["n_chars"] = F.coalesce(count, F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    # named by place while the count is beside them, so no column of docs can clash with it
    placed = out.select(*[named[c].alias(f"_{i}") for i, c in enumerate(cols)], "copies")
    return _each(placed, [f"_{i}" for i in range(len(cols))]).toDF(*cols)
