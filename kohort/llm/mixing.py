"""Mixing sources to target weights, with DataFrame and SQL functions only.

1. Sizes: words of each document; a source's target is its weight's share of all words,
   held at ``max_repeats`` times its size, the excess reshared by weight (a common level
   per weight, found by one cumulative pass over the sources).
2. Packing: the documents of a source form one stream of words, cut into blocks of
   ``block_words``. Stream offsets are prefix sums on two levels: inside hashed buckets
   (about sqrt(rows) of them, so a hot source is spread) and over the bucket totals.
3. Draw: every output shard of ``shard_slots`` slots draws how many of its slots each source
   fills. The draw is multinomial, conditioned on the totals that meet the targets: the
   slots of all sources are dealt to the shards by one pseudorandom permutation.
4. Mapping: a source's slots, numbered in shard order, run through a pseudorandom
   permutation of its block indices, a new one for each pass over the source. No block is
   used more than ``max_repeats`` times, so no document is.
5. Blocks are joined by (source, index).

Permutations are swap-or-not shuffles: any domain size up to 2^62, no cycle walking, two hashes
a round, computed in the JVM. All numbers follow from the rows and the seed, so
reruns and recomputed partitions agree.

Defined results: a null text has size 0; a document of size 0 is never taken; null is a
source of its own, ordered last; a source of size 0 has target 0; rows with a null or
repeated doc_id are documents of their own; an empty table gives an empty result; other
columns are only hashed, to tell rows apart, and carried. Sources are few: the order of sources
and the level of their targets are one pass over a table of a row a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.llm.common import cut

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SHARDS_A_PART = 4096
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
ROUNDS = 12
SEED = 20240229
WORD = r"[^\x20\x09-\x0D]+"


def permuted(df: DataFrame, x: str, n: str, key: str, name: str, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``name``: the place of x in a pseudorandom permutation of [0, n) chosen by key.
    x, n and key are SQL expressions of long columns. All rounds are one expression."""
    partner = "(pmod(xxhash64(_key, r), _m) + _m - x) % _m"  # x and its partner add up to the round's sum
    step = f"CASE WHEN xxhash64(greatest(x, {partner}), r, _key) % 2 = 0 THEN {partner} ELSE x END"
    place = f"aggregate(transform(sequence(1, {rounds}), i -> CAST(i AS BIGINT)), _x, (x, r) -> {step})"
    df = df.select("*", *[F.expr(e).cast("long").alias(c) for c, e in (("_x", x), ("_m", n), ("_key", key))])
    return df.withColumn(name, F.expr(place)).drop("_x", "_m", "_key")


def _row_hash(docs: DataFrame):
    """A hash of all columns; nulls, which it skips, are told by their places."""
    return F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, copy, source, size): rid is a hash of the row; equal rows are counted (in part before they
    are shuffled) and numbered by copy."""
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _row_hash(docs).alias("rid"),
                        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    counts = small.groupBy("doc_id", "rid", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    return cut(counts.select("doc_id", "rid", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")))


def source_targets(rows: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a source: sid, source, source_size, target, n_blocks, slots, first_slot, all_slots."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here: the order of sources and the common level are over that table
    all_ = Window.partitionBy(F.lit(0))
    per = per.withColumn("sid", F.row_number().over(all_.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_repeats))
    level = all_.orderBy(F.expr("cap / w"), "sid")
    per = (per.withColumn("before", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("rest_w", F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("total", F.sum("source_size").over(all_))
           .withColumn("lam", F.expr("(total - before) / rest_w"))
           # the first source, by cap over weight, that the level of the rest leaves under its cap
           .withColumn("lam", F.min(F.expr("CASE WHEN lam <= cap / w THEN struct(cap / w AS o, sid, lam) END")).over(all_)["lam"]))
    per = per.withColumn("target", F.expr("CASE WHEN lam IS NULL THEN cap ELSE least(cap, lam * w) END"))
    per = per.withColumn("n_blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    slots = f"CASE WHEN source_size = 0 THEN 0 ELSE least({max_repeats} * n_blocks, CAST(floor(target * n_blocks / source_size + 0.5) AS BIGINT)) END"
    per = per.withColumn("slots", F.expr(slots).cast("long"))
    per = (per.withColumn("first_slot", F.coalesce(F.sum("slots").over(all_.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("all_slots", F.sum("slots").over(all_)))
    return cut(per.select(F.col("sid").cast("long").alias("sid"), "source", "source_size", "target", "n_blocks", "slots", "first_slot", "all_slots"))


def _spread(df: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
    """A row for each number of [lo, hi), hi > lo; ranges are first cut to chunks that are dealt to
    all tasks (their count is given, for the chunks alone look too small to keep apart)."""
    chunk, n = 1 << 13, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut_up = (df.withColumn("_lo", F.expr(lo)).withColumn("_hi", F.expr(hi))
              .withColumn("_c", F.explode(F.expr(f"sequence(0L, (_hi - _lo - 1) div {chunk})")))
              .repartition(n, *df.columns, "_c"))
    numbers = F.expr(f"sequence(_lo + _c * {chunk}, least(_hi, _lo + (_c + 1) * {chunk}) - 1)")
    return cut_up.withColumn(name, F.explode(numbers)).drop("_lo", "_hi", "_c")


def draw_slots(sources: DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row a slot of the mix: shard, sid, t (its number among the source's slots), pass, block."""
    dealt = _spread(sources.where("slots > 0").select("sid", "n_blocks", "first_slot", "all_slots", "slots"), "0L", "slots", "i")
    dealt = permuted(dealt, "first_slot + i", "all_slots", str(seed % 1000003), "g")
    # each shard's draw: how many slots each source fills
    counts = (dealt.withColumn("shard", F.expr(f"g div {shard_slots}"))
              .groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"), F.first("n_blocks").alias("n_blocks")))
    # a source's slots ahead of each shard, on two levels: a hot source has a row a shard
    counts = counts.withColumn("part", F.expr(f"shard div {SHARDS_A_PART}"))
    parts = counts.groupBy("sid", "part").agg(F.sum("n").alias("in_part"))
    earlier = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("sid", "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("base"))
    ahead = Window.partitionBy("sid", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("t0", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(parts.hint("merge"), ["sid", "part"])
              .withColumn("t0", F.col("t0") + F.col("base")).drop("part", "base"))
    slots = _spread(counts, "t0", "t0 + n", "t")
    slots = slots.withColumn("pass", F.expr("t div n_blocks"))
    return permuted(slots, "t % n_blocks", "n_blocks", f"(sid * 97 + pass + {seed % 999983})", "block").select("shard", "sid", "t", "pass", "block")


def packed(rows: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where documents lie in the blocks of their source: doc_id, rid, copy, size, sid, block, and the
    document's words [lo, hi) that the block holds. Documents of size 0 lie nowhere."""
    n = rows.count()
    buckets = max(1, int(n ** 0.5))
    named = (rows.where("size > 0").alias("r").join(sources.select("source", "sid").alias("s"), F.expr("r.source <=> s.source"))
             .select("doc_id", "rid", "copy", "size", "sid"))
    named = named.withColumn("bucket", F.pmod(F.xxhash64("rid", "copy"), F.lit(buckets)))
    sums = named.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "rid", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = (named.withColumn("off", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(sums, ["sid", "bucket"]).withColumn("start", F.expr("base + off")))
    return (placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
            .select("doc_id", "rid", "copy", "size", "sid", "block",
                    F.expr(f"greatest(0L, block * {block_words} - start)").alias("lo"),
                    F.expr(f"least(size, (block + 1) * {block_words} - start)").alias("hi")))


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS):
    """(rows, sources, slots, pieces): sizes, targets, the drawn slots, and the packed documents."""
    rows = sized(docs)
    sources = source_targets(rows, block_words=block_words)
    return rows, sources, draw_slots(sources, seed, shard_slots), packed(rows, sources, block_words)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target, taken."""
    rows, sources, slots, pieces = mix(docs)
    used = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    # slots and pieces grow with the input though they come from a few rows: never broadcast them
    taken = (pieces.join(used.hint("merge"), ["sid", "block"]).groupBy("doc_id", "rid", "copy")
             .agg(F.sum(F.expr("(hi - lo) * times")).alias("taken")))
    return (rows.alias("r").join(sources.alias("s"), F.expr("r.source <=> s.source"))
            .join(taken.hint("merge").alias("t"), F.expr("r.doc_id <=> t.doc_id AND r.rid = t.rid AND r.copy = t.copy"), "left")
            .select("r.doc_id", "r.size", "s.source_size", "s.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of docs: for each pass in which a document is
    taken a row with its words taken then (its whole text, if all are; else the words in
    order, joined by a space; n_chars follows)."""
    _, _, slots, pieces = mix(docs)
    parts = (pieces.join(slots.select("sid", "block", "pass").hint("merge"), ["sid", "block"])
             .groupBy("doc_id", "rid", "copy", "size", "pass")
             .agg(F.sum(F.expr("hi - lo")).alias("taken"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
             .select("doc_id", "rid", F.expr("taken = size").alias("whole"), F.expr("CASE WHEN taken < size THEN spans END").alias("spans")))
    # columns travel as one, so no name can clash; equal rows collapse, each copy has parts of its own
    cols = docs.columns
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash(docs).alias("rid"), F.struct(*cols).alias("row"))
            .groupBy("doc_id", "rid").agg(F.first("row").alias("row")))
    # the text is split once, whatever the number of spans
    some = F.expr(f"transform(array(regexp_extract_all(row.text, r'({WORD})', 1)), w -> "
                  "array_join(flatten(transform(spans, s -> slice(w, CAST(s.lo + 1 AS INT), CAST(s.hi - s.lo AS INT)))), ' '))[0]")
    out = (rows.alias("d").join(parts.hint("merge").alias("p"), F.expr("d.doc_id <=> p.doc_id AND d.rid = p.rid"))
           .select("row", F.when(F.col("whole"), F.col("row.text")).otherwise(some).alias("taken")))
    named = {c: F.col("row")[c] for c in cols} | {"text": F.col("taken")}
    if "n_chars" in cols:
        named["n_chars"] = F.length("taken").cast(docs.schema["n_chars"].dataType)
    return out.select(*[named[c].alias(c) for c in cols])
