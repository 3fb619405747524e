"""Top-k products against brute force; pruning, ties and edge cases."""

import numpy as np
import pytest

from kohort.checks.compare import compare, duckdb_views
from kohort.llm import mtree as M
from kohort.llm.common import table
from kohort.llm.queries import ORACLES
from tests.conftest import SF001, SF01


def slow(rows, k, every):
    rows = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        own = min(v for i, v in rows if i == q)
        got = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(got)]
    return sorted(out)


def test_given_embeddings(spark):
    df = table(spark, SF001, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, M.top_k(df).collect())) == slow(rows, 20, 20)
    assert compare(M.top_k(table(spark, SF01, "embeddings"), block=64, pivots=8), duckdb_views(SF01), ORACLES["op3_mtree"]) == []


def test_ties_repeats_and_bad_rows(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.integers(-2, 3, 3).astype(float).tolist()) for i in range(400)] + [(40, [1.0, 1.0, 1.0]), (41, [0.5, 0.25, 0.0]), (41, [0.5, 0.25, 0.0])]
    bad = [(None, [1.0, 1.0, 1.0]), (60, None), (61, [1.0, None, 2.0]), (62, [float("nan")] * 3), (63, [float("inf"), 0.0, 0.0])]
    schema = "vec_id long, embedding array<float>, score int, rank string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], schema)
    for pivots, block in ((4, 50), (64, 4096)):
        assert sorted(map(tuple, M.top_k(df, pivots=pivots, block=block).collect())) == slow(rows, 20, 20)
    few = spark.createDataFrame([(0, [1.0], 1, ""), (3, [2.0], 1, "")], schema)
    assert [tuple(r) for r in M.top_k(few).collect()] == [(0, 1, 3, 8192)]
    assert M.top_k(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        M.top_k(spark.createDataFrame([(0, [1.0], 1, ""), (3, [2.0, 1.0], 1, "")], schema))


def test_search_prunes():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(20, 8)) * 100
    x = np.floor(np.concatenate([c + rnd.normal(size=(300, 8)) for c in centres]))
    m2 = (x ** 2).sum(axis=1).max()
    tree = M.MTree(M.augmented(x, m2), m2)
    ids = np.arange(len(x))
    for i in range(0, len(x), 501):
        got, s, computed = tree.search(np.append(x[i], 0.0), 10, ids, i, np.inf)
        want = np.lexsort((ids, -(x @ x[i])))
        np.testing.assert_array_equal(got, want[want != i][:10])
        assert computed < len(x) / 2


def test_a_row_repeated_thousands_of_times(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.integers(-2, 3, 3).astype(float).tolist()) for i in range(100)] + [(7, [2.0, 2.0, 2.0])] * 3000 + [(20, [2.0, 2.0, 1.0])] * 3000
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, rank string")
    assert sorted(map(tuple, M.top_k(df, pivots=4, block=50).collect())) == slow(rows, 20, 20)
