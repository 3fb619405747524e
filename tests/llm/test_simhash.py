"""SimHash components against brute force over all pairs."""

import random

from xxhash import xxh64_intdigest

from kohort.llm import simhash
from kohort.llm.common import table
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, fp string, component_id long"


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """[(id, fp)] -> {row index: component}."""
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i in range(len(fps)):
        ids = [fps[j][0] for j in range(len(fps)) if group[j] == group[i] and fps[j][0] is not None]
        out.append(min(ids) if ids else None)
    return out


def check(rows, df):
    fps = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(fps, slow_components(fps))), key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == want


def test_given_documents(spark):
    docs = table(spark, SF001, "documents")
    check([(r.doc_id, r.text) for r in docs.collect()], simhash.digest(docs))


def test_edges_and_repeats(spark):
    rows = [(5, None), (3, ""), (4, " \t\n"), (7, "one"), (8, "ONE"), (9, "one two"), (9, "one two"), (None, "one two"),
            (None, "alone here now"), (11, "A b C d e"), (10, "a B c D e"), (12, "x y \x1c z"), (13, "w " * 200_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    check(rows, simhash.digest(df))
    assert simhash.digest(df.limit(0)).collect() == []


def test_long_lists_give_the_same_components(spark):
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    fps = {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(150)}
    fps |= {centre ^ 0xFFFF ^ (rnd.getrandbits(3) << 40) for _ in range(30)} | {rnd.getrandbits(64) for _ in range(50)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from kohort.llm.common import components
    want = slow_components([(f, f & (1 << 64) - 1) for f in fps])
    for limit in (2, 64, 10_000):
        root = {r.node: r.root for r in components(simhash.links(df, limit)).collect()}
        assert [root.get(f, f) for f in fps] == want


def test_tokens_count_shared_bytes():
    assert len(simhash.BLOCKS) == 14 and simhash.MIN_SHARED == 3
    for n in range(256):
        same = {p for p in range(8) if n >> p & 1}
        shared = sum(set(c) <= same for c in simhash.BLOCKS)
        assert (shared >= simhash.MIN_SHARED) == (len(same) >= 6)


def test_counted_pairs_are_all_near_pairs(spark):
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(20)} | {0, (1 << 64) - 1}
    for f in sorted(fps):
        for _ in range(12):   # up to five differing bits, often in one byte
            bits = rnd.sample(range(64), rnd.randrange(1, 6)) if rnd.random() < 0.6 else [8 * rnd.randrange(8) + b for b in rnd.sample(range(8), 2)]
            fps.add(f ^ sum(1 << b for b in bits))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 10_000).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def test_keep_first(spark):
    rows = [(2, "a b c d"), (1, "a b c d"), (1, "a b c d"), (3, "quite another text of words"), (None, "a b c d")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_first(df).collect()) == [(False, 1), (False, 3)]


def test_keep_first_keeps_a_row_of_every_component(spark):
    x, near, y, z = "one text about a river", "ONE text about a river", "quite another text of words", "the third one has nothing in common"
    rows = [(5, x), (5, y), (3, near), (3, near), (7, z), (None, z), (None, z), (None, "only unnamed rows here"), (None, "only UNNAMED rows here"), (5, "r s t u v")]
    df = spark.createDataFrame([(*r, "x" if i % 2 else None, i if r[0] else 1) for i, r in enumerate(rows)], SCHEMA)
    got = sorted(((r.doc_id, r.text.lower()) for r in simhash.keep_first(df).collect()), key=str)
    assert got == sorted([(3, x), (5, y), (5, "r s t u v"), (7, z), (None, "only unnamed rows here")], key=str)
    same = spark.createDataFrame([(4, x, None, 1)] * 3, SCHEMA)
    assert simhash.keep_first(same).count() == 1 and simhash.keep_first(same.limit(0)).collect() == []
    # columns that only nulls tell apart, of one id: rows of one component
    moved = spark.createDataFrame([(4, x, "7", None, "a"), (4, x, None, "7", "a")], "doc_id long, text string, p string, q string, fp string")
    assert simhash.keep_first(moved).count() == 1


def test_keep_first_with_clashing_columns(spark):
    rows = [(2, "a b c d", 1, 2, 3, "x"), (1, "a b c d", 4, 5, 6, "y"), (3, "quite another text of words", 7, 8, 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h1 long, h1 long, row int, root string")
    out = simhash.keep_first(df)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == sorted(rows[1:])
