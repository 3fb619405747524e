"""SimHash near-duplicates through an inverted index of positional bytes.

A fingerprint is eight bytes. Two fingerprints that differ in at most ``MAX_BITS`` = 2 bits
share at least six of their eight positional bytes. Lists of single bytes would hold one
256th of the corpus each, so the index posts positional bytes by fours: ``BLOCKS`` are the 14
sets of four of the eight places whose exclusive or is zero, in which any three places lie in
exactly one set. Two fingerprints that share six bytes have 3 of the 14 tokens in common, with
seven bytes 7, with five bytes 1, with fewer at most 1. So the number of lists in which a pair
meets tells whether it shares six positional bytes.

Pairs that meet in a list are tallied over all lists, those with fewer than ``MIN_SHARED`` = 3
tokens are dropped, the rest is verified by the Hamming distance. Lists of more than
``list_limit`` distinct fingerprints (large groups of near copies) are never paired;
there each posting is filed under its 33 one-bit flips of the remaining 32 bits. Two
fingerprints of the list are within two bits exactly if they meet under one of these, and at
most 33 distinct fingerprints can meet under one, so a list costs 33 rows a posting. A pair
within two bits thus either has a long list in common, which links it, or meets in three or
more short ones.

Equal fingerprints are collapsed before the index, so copies cost one row.

Defined results: null and blank texts have fingerprint zero and link like any other; rows
with a null doc_id take part, but never name a component; a component of such rows only has
component_id null; repeated rows each return a row; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.llm.common import components, cut, ship, slices, text_bytes

SHINGLE_WORDS = 3
MAX_BITS = 2
LIST_LIMIT = 64
#: sets of four byte places of a token; any three places are in one of the 14
BLOCKS = [c for c in combinations(range(8), 4) if not c[0] ^ c[1] ^ c[2] ^ c[3]]
#: tokens that remain when two byte places differ
MIN_SHARED = sum(not {0, 1} & set(c) for c in BLOCKS)
_CHUNK = 1 << 16


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of whole UTF-8 text: majority bits of the XXH64 of its k-word shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest
    words = text.lower().split()  # bytes: lower-cases A-Z only, splits at \x20 and \x09-\x0D
    n = len(words) - k + 1
    if not words:
        return 0
    if n < 1:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    counts = np.zeros(64, np.int64)
    for c in range(0, n, _CHUNK):
        top = min(n, c + _CHUNK)
        spans = zip(starts[c:top].tolist(), (ends[c + k - 1:top + k - 1] - 1).tolist())
        h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, top - c)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, more: tuple = ()) -> DataFrame:
    """Rows (doc_id, fp), and the long columns ``more`` of docs: fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.simhash import fingerprint
        for b in (part for batch in batches for part in slices(batch)):
            fps = [f - (1 << 64) if f >= 1 << 63 else f for f in (fingerprint(t, k) for t in text_bytes(b, "text"))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *more])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
            .mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more))))


def _bytes_at(fp, places):
    """The bytes at four places as one number."""
    at = [F.shiftleft(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(0xFF).cast("long")), 8 * i) for i, p in enumerate(places)]
    return at[0].bitwiseOR(at[1]).bitwiseOR(at[2]).bitwiseOR(at[3])


def links(fps: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of the distinct fingerprints
    ``fps`` (fp long) within two bits. Pairs in short lists are all there; a long list gives
    each member a link to the smallest member of every flip key that it shares."""
    fp = F.col("fp")
    tokens = F.array(*[F.struct(F.lit(t).alias("place"), _bytes_at(fp, c).alias("token"), _bytes_at(fp, [p for p in range(8) if p not in c]).alias("rest"))
                       for t, c in enumerate(BLOCKS)])
    postings = fps.select("fp", F.explode(tokens).alias("p")).select("fp", "p.*")
    sizes = postings.groupBy("place", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = cut(postings.join(sizes, ["place", "token"]))
    short = lists.where(F.col("n") <= list_limit).select("place", "token", "fp")
    # count filter: the tokens that a pair shares over all lists, then the exact distance
    met = (short.select("place", "token", F.col("fp").alias("a"))
           .join(short.select("place", "token", F.col("fp").alias("b")), ["place", "token"]).where("a < b"))
    tally = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= MIN_SHARED)
    near = tally.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    # long lists: meet under one-bit flips of the other 32 bits
    flips = F.concat(F.array(F.col("rest")),
                     F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("rest").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    long = (lists.where(F.col("n") > list_limit).select("place", "token", "fp", F.explode(flips).alias("flip"))
            .groupBy("place", "token", "flip").agg(F.collect_set("fp").alias("fps"))  # at most 33 by construction
            .where(F.size("fps") > 1)
            .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))
    return near.unionByName(long).distinct()


def _with_roots(distinct: DataFrame, list_limit: int) -> DataFrame:
    """Adds root, the component, to the distinct fingerprints (fp and other columns)."""
    comps = components(links(distinct.select("fp"), list_limit))
    return distinct.join(comps, F.col("fp") == F.col("node"), "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Rows (doc_id, fp, component_id) for every row of docs (doc_id, text)."""
    rows = cut(with_fingerprints(docs, k))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = _with_roots(distinct, list_limit)
    ids = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, k: int = SHINGLE_WORDS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """One row of each component: that of the smallest doc_id (nulls last), of several the first by a
    hash of the whole row. The columns travel as one, so no name can clash."""
    cols = docs.columns
    # a row is known by 128 bits of all its columns; nulls, which the hash skips, by their places
    whole = [*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols]]
    known = docs.select(F.struct(*cols).alias("row"), F.xxhash64(F.lit(1), *whole).alias("h1"), F.xxhash64(F.lit(2), *whole).alias("h2"))
    asked = known.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"), "h1", "h2")
    rows = with_fingerprints(asked, k, ("h1", "h2"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2"))
    distinct = cut(rows.groupBy("fp").agg(first.alias("first")))
    kept = _with_roots(distinct, list_limit).groupBy("root").agg(F.min("first").alias("r")).select("r.h1", "r.h2")
    # equal rows have one fingerprint, so one component; they collapse before they are dealt out
    return known.dropDuplicates(["h1", "h2"]).join(kept.hint("merge"), ["h1", "h2"], "left_semi").select(*[F.col("row")[c].alias(c) for c in cols])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
