"""Ranked search against brute force over all documents; the K2-treap; the descent."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from kohort.llm import treap as T
from kohort.llm.common import table
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, item_id string, score int, qid string"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_UPPER))


def slow(docs, items, top=20):
    """Rows (item_id, rank, doc_id, score) of lists of (id, text)."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_all, l_all = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_all) // l_all
            s = sum(q * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_given_tables(spark):
    docs, items = table(spark, SF001, "documents"), table(spark, SF001, "benchmark")
    want = slow([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(T.top_documents(docs, items)) == want
    assert rows_of(T.top_documents(docs, items, docs_a_grid=520, item_bytes=1500)) == want  # several grids, several blocks of items


def made(seed, n, most):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "été", "ÉTÉ", "x1", "7", "日本", "straße", "a_b", "don't", "rare" + "z" * 300] + [f"w{i}" for i in range(60)]
    return [" ".join(rnd.choice(words[:int(rnd.random() ** 2 * len(words)) + 1]) for _ in range(rnd.randrange(most))) for _ in range(n)]


def test_made_tables(spark):
    docs = [(i if i % 9 else None, t) for i, t in enumerate(made(1, 700, 30))] + [(3, None), (None, None), (4, ""), (5, "... ;;"), (6, "the of"), (6, "the of"), (6, "the of w1")]
    docs += [(900 + i, "the same row w5") for i in range(40)] + [(2000, "w9 " * 120_000 + "w10"), (2001, "y" * 400_000 + " w3"), (2002, "w3," * 100_000)]
    items = list(enumerate(made(2, 25, 12))) + [(3, "w1 w1 w1"), (3, "w1 w1 w1"), (None, "w5 the"), (70, None), (71, "no such terms"), (72, "y" * 400_000), (73, "THE the")]
    d = spark.createDataFrame([(*r, "x", 1, None) for r in docs], SCHEMA)
    i = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")
    want = slow(docs, items)
    assert rows_of(T.top_documents(d, i)) == want
    assert rows_of(T.top_documents(d, i, docs_a_grid=512, item_bytes=100)) == want
    assert rows_of(T.top_documents(d, i, top=3)) == slow(docs, items, 3)
    for x, y in ((d.limit(0), i), (d, i.limit(0)), (d.limit(0), i.limit(0))):
        assert T.top_documents(x, y).collect() == []


def test_oracle_sql(spark):
    docs, items = [(i, t) for i, t in enumerate(made(5, 300, 25))] + [(7, None), (None, "the w1")], list(enumerate(made(6, 20, 10))) + [(1, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(T.ORACLE).fetchall(), key=str) == slow(docs, items)


def test_treap_cells_and_maxima():
    rnd = np.random.default_rng(3)
    cells = {(int(r), int(c)): int(v) for r, c, v in zip(rnd.integers(0, 50, 400), rnd.integers(0, 64, 400), rnd.integers(1, 1000, 400))}
    rows, cols = np.array(list(cells), np.int64).T
    values = np.array(list(cells.values()), np.int64)
    tree = T.Treap.read(T.Treap.of(rows, cols, values, 6).body())
    assert tree.drop[0][0] == values.max()
    for r in range(64):
        for c in range(64):
            node, most = np.zeros(1, np.int64), int(tree.drop[0][0])
            for level in range(6):
                half = 5 - level
                node = tree.child(level, node, np.array([(r >> half & 1) << 1 | c >> half & 1]))
                if node[0] < 0:
                    break
                most -= int(tree.drop[level + 1][node[0]])
                assert most == max(v for (x, y), v in cells.items() if x >> half == r >> half and y >> half == c >> half)
            assert (node[0] >= 0) == ((r, c) in cells) and (node[0] < 0 or most == cells[r, c])


def test_descent_leaves_ranges_out():
    rnd = np.random.default_rng(4)
    rows, cols = np.repeat(np.arange(32), 4096), np.tile(np.arange(4096), 32)
    keep = rnd.random(len(rows)) < 0.2
    rows, cols = rows[keep], cols[keep]
    values = rnd.integers(1, 1000, len(rows)) + np.where(cols % 512 < 30, 200_000, 0)  # some documents are far better
    tree = T.Treap.of(rows, cols, values, 12)
    own, w = np.array([1, 5, 9]), np.array([3, 2, 7])
    best = T.Best(20)
    met = T.search(tree, 4096, own, w, best, lambda c: [(0, int(x)) for x in c])
    full = np.zeros(4096, np.int64)
    for r, x in zip(own, w):
        np.add.at(full, cols[rows == r], x * values[rows == r])
    assert [(-s, c) for s, _, c in best.held] == sorted(((int(s), c) for c, s in enumerate(full)), key=lambda p: (-p[0], p[1]))[:20]
    assert met < 4096  # an exhaustive descent meets all 4096 columns and the ranges above them
