"""The mix: targets by hand, packing by brute force, permutations, repeats."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kohort.llm import mixing
from kohort.llm.common import table
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken string, sid long"


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def slow_targets(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[1]] += r[2]
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        rest, ws = total - sum(held.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / ws > 3 * sizes[s]]
        if not over:
            return sizes, {s: held.get(s, rest * w[s] / ws if ws else 0) for s in names}
        held |= {s: 3 * sizes[s] for s in over}


def check(docs, near):
    rows = [(r.doc_id, r.source, size(r.text)) for r in docs.collect()]
    sizes, targets = slow_targets(rows)
    got = mixing.digest(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size, round(r.target, 6)) for r in got) == sorted(
        (i is None, i or 0, n, sizes[s], round(targets[s], 6)) for i, s, n in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, mixing.digest(docs.repartition(7)).collect())) == sorted(map(str, got))
    source = {r[0]: r[1] for r in rows}
    taken = defaultdict(int)
    for r in got:
        taken[source[r.doc_id]] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(near * t, 2 * mixing.BLOCK_WORDS), (s, taken[s], t)


def test_given_documents(spark):
    check(table(spark, SF001, "documents"), 0.03)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (4, "x " * 5000, "b"), (5, "y\x0bz\x1c", "b"), (6, " \n", "c"),
            (7, "w w w", "é"), (8, "dup dup", "Z"), (8, "dup dup", "Z"), (None, "no id", "Z")]
    df = spark.createDataFrame([(i, t, "en", s, 0, "t", 9) for i, t, s in rows], SCHEMA)
    check(df, 0.05)
    assert mixing.digest(df.limit(0)).collect() == []
    assert mixing.mixed_documents(df.limit(0)).collect() == []


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 17, 64, 1000):
        df = mixing.permuted(spark.range(n).withColumn("n", F.lit(n).cast("long")), "id", "n", "5L", "p")
        got = [r.p for r in df.orderBy("id").collect()]
        assert sorted(got) == list(range(n))
        assert n < 17 or got != list(range(n))


def test_mixed_documents_hold_what_the_digest_counts(spark):
    docs = table(spark, SF001, "documents")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    texts = {r.doc_id: r for r in docs.collect()}
    for r in out.collect():
        words[r.doc_id] += size(r.text)
        whole = texts[r.doc_id]
        assert (r.source, r.lang, r.n_chars) == (whole.source, whole.lang, len(r.text))
        assert r.text == whole.text or not Counter(r.text.split(" ")) - Counter(re.findall(r"[^\x20\x09-\x0D]+", whole.text))
    assert {i: n for i, n in words.items() if n} == {r.doc_id: r.taken for r in mixing.digest(docs).collect() if r.taken}


def test_shards_draw_all_slots(spark):
    _, sources, slots, _ = mixing.mix(table(spark, SF001, "documents"), shard_slots=100)
    total = sources.first().all_slots
    per = {r.shard: r["count"] for r in slots.groupBy("shard").count().collect()}
    assert sum(per.values()) == total and all(n == 100 for s, n in per.items() if s < max(per))
    assert slots.groupBy("sid", "block").count().agg(F.max("count")).first()[0] <= 3


def test_permutations_mix_large_domains(spark):
    for n in (10 ** 12, 3 * 10 ** 15):
        step = n // 5000
        df = mixing.permuted(spark.range(5000).selectExpr(f"id * {step}L AS id", f"{n}L AS n"), "id", "n", "7L", "p")
        got = [(r.id, r.p) for r in df.collect()]
        assert len({p for _, p in got}) == 5000 and all(0 <= p < n for _, p in got)
        tenths = Counter(p * 10 // n for _, p in got)
        assert all(400 < tenths[i] < 600 for i in range(10))  # 500 each, give or take five deviations
        stayed = sum(min(abs(p - x), abs(p + x - n)) < n // 20 for x, p in got)
        assert stayed < 5000 * 0.25  # as chance would have it: 0.1 for each of the two
    edge = mixing.permuted(spark.range(16).withColumn("n", F.lit(16).cast("long")), "id", "n", "9L", "p")
    assert sorted(r.p for r in edge.collect()) == list(range(16))


def test_packing_by_brute_force(spark):
    rows = [(i % 30 if i % 11 else None, "w " * (i * 7 % 50), "ab"[i % 2]) for i in range(120)] + [(3, "x y", "a")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    held, sources, _, pieces = mixing.mix(docs, block_words=16)
    held, pieces = held.collect(), pieces.collect()
    assert Counter((r.doc_id, r.size, r.source) for r in held) == Counter((i, size(t), s) for i, t, s in rows)
    assert len({(r.doc_id, r.rid, r.copy) for r in held}) == len(rows)
    names = {r.sid: (r.source, r.source_size, r.n_blocks) for r in sources.collect()}
    blocks, spans = defaultdict(int), defaultdict(list)
    for p in pieces:
        assert 0 <= p.lo < p.hi <= p.size
        blocks[p.sid, p.block] += p.hi - p.lo
        spans[p.doc_id, p.rid, p.copy].append((p.block, p.lo, p.hi))
    for r in held:
        at = 0
        for _, lo, hi in sorted(spans.get((r.doc_id, r.rid, r.copy), [])):  # a document lies in consecutive blocks, in order, once
            assert lo == at
            at = hi
        assert at == r.size
    for sid, (_, words, n) in names.items():  # all blocks are full but the last
        assert [blocks[sid, b] for b in range(n)] == [16] * (n - 1) + [words - 16 * (n - 1)] * (n > 0)


def test_many_rows_of_one_id_and_clashing_columns(spark):
    rows = [(None, f"a b c {i % 100}", "s", 1, 2, 3, 70 + i % 2) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rid int, _spans int, _id int, _n int")
    got = mixing.digest(docs).collect()
    assert len(got) == 10_000 and {r.size for r in got} == {4} and sum(r.taken for r in got) == 40_000
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    back = [tuple(r) for r in out.collect()]
    assert sum(size(r[1]) for r in back) == 40_000 and {r[3:6] for r in back} == {(1, 2, 3)} and {r[6] for r in back} == {70, 71}
