"""Line dedup against brute force; cuckoo filters; insertions and deletions that undo each other."""

import random
import re
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
from xxhash import xxh3_128_digest

from kohort.llm import line_dedup as L
from kohort.llm.common import table
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, rid string, hi int, gone string"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(_UPPER)


def frequent(texts, min_chars, min_docs):
    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    return {k for k, n in held.items() if n >= min_docs}


def slow(texts, min_chars=1, min_docs=10):
    gone = frequent(texts, min_chars, min_docs)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check(rows, df, bits=8, **more):
    want = sorted(((r[0], n, d, sha256(k.encode()).hexdigest()) for r, (n, d, k) in zip(rows, slow([r[1] for r in rows], **more))), key=str)
    assert sorted((tuple(r) for r in L.digest(df, bits=bits, **more).collect()), key=str) == want


def made(seed, n):
    rnd = random.Random(seed)
    lines = ["Menu", " menu\t", "é", "É", "ß\x1c", "\x0bshare this\x0c", "a" * 3000, "", "  ", "Read More", "read more\r", "日本", "\x85x", "x"] + [f"line {i}" for i in range(40)]
    return ["\n".join(rnd.choice(lines) if rnd.random() < 0.7 else f"own {rnd.random()}" for _ in range(rnd.randrange(0, 12))) for _ in range(n)]


def test_given_documents(spark):
    docs = table(spark, SF001, "documents")
    check([(r.doc_id, r.text) for r in docs.collect()], docs)
    check([(r.doc_id, r.text) for r in docs.collect()], docs, min_docs=2, min_chars=5)


def test_made_texts(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(made(1, 200))] + [(5, None), (None, None), (6, ""), (8, "menu\nmenu\nmenu"), (9, "w\n" * 50_000)]
    rows += [(20, "all\nthe same\nrow")] * 12
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)
    check(rows, df)
    check(rows, df, min_docs=1)
    check(rows, df, min_docs=3, min_chars=2)
    check(rows, df, min_docs=10_000)
    check(rows, df, bits=1)
    assert L.digest(df.limit(0)).collect() == []


def test_oracle_sql(spark):
    rows = [(i, t) for i, t in enumerate(made(3, 120))] + [(500, None), (500, None), (None, "menu")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(L.ORACLE).fetchall(), key=str)
    assert sorted((tuple(r) for r in L.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want


def test_cuckoo_filter():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(-2 ** 63, 2 ** 63 - 1, 5000))
    f = L.CuckooFilter.sized(len(keys))
    assert f.insert(keys) and f.holds(keys).all()
    assert f.holds(rnd.integers(-2 ** 63, 2 ** 63 - 1, 100_000)).mean() < 0.001
    empty = L.CuckooFilter.sized(len(keys))
    half = keys[::2]
    f.delete(half)
    assert f.holds(keys[1::2]).all() and f.holds(half).mean() < 0.01
    f.delete(keys[1::2])
    assert not f.buckets.any() and f.buckets.shape == empty.buckets.shape
    assert not L.CuckooFilter.sized(1).insert(keys[:100])  # full: says so
    assert L.CuckooFilter.of(f.body()).buckets.shape == f.buckets.shape


def test_long_enough_counts_code_points():
    assert [L.long_enough(k.encode(), 2) for k in ("", "é", "ab", "éé", "日", "日本")] == [False, False, True, True, False, True]


def test_insertions_and_deletions(spark, tmp_path):
    texts = made(5, 150)
    part = [texts[:60], texts[60:110], texts[110:]]
    df = [spark.createDataFrame(list(enumerate(p)), "doc_id long, text string") for p in part]

    def state(index):
        refs = sorted(tuple(r) for r in index.references().collect())
        held = {k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k}
        names = {k: np.frombuffer(xxh3_128_digest(k.encode()), np.int64) for k in held}
        filters = {r.shard: L.CuckooFilter.of(r.body) for r in index.filters().collect()}
        inside = {k for k, (hi, lo) in names.items() if (s := int(hi) >> 60 & 15) in filters and filters[s].holds(np.array([lo]))[0]}
        return refs, inside

    def inserted(which):
        return [t for i in which for t in part[i]]

    index = L.LineIndex(spark, str(tmp_path), min_docs=4, bits=4)
    assert index.kept(df[0]).count() == 60  # nothing is frequent yet
    seen = {}
    for name, step in (("a", lambda x: x.insert(df[0])), ("ab", lambda x: x.insert(df[1])), ("abc", lambda x: x.insert(df[2])), ("ac", lambda x: x.delete(df[1])),
                       ("c", lambda x: x.delete(df[0])), ("ca", lambda x: x.insert(df[0])), ("a", lambda x: x.delete(df[2]))):
        index = step(index)
        which = ["abc".index(c) for c in sorted(name)]
        refs, inside = state(index)
        want = frequent(inserted(which), 1, 4)
        assert want <= inside and len(inside - want) <= 2  # the filter holds what is frequent, and next to nothing else
        assert sum(r[3] for r in refs) == sum(len({key(x) for x in t.split("\n")} - {""}) for t in inserted(which))
        got = sorted((r.doc_id, r.text) for r in index.kept(df[2]).collect())
        assert got == sorted((i, "\n".join(x for x in t.split("\n") if key(x) not in want)) for i, t in enumerate(part[2]))
        same = "".join(sorted(name))
        assert seen.setdefault(same, refs) == refs  # however it was reached
    assert sorted(tuple(r) for r in L.LineIndex(spark, str(tmp_path), 1, min_docs=4, bits=4).references().collect()) == seen["a"]  # older versions stay
