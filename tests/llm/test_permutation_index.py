"""Footrule distances by hand, recall against brute force, ties and edge cases."""

import numpy as np
import pytest

from kohort.llm import permutation_index as P
from kohort.llm.common import table
from tests.conftest import SF01

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def slow(rows, k, every):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        own = min((v.tolist() for i, v in rows if i == q))
        got = sorted((float(np.sqrt(((np.array(own) - v) ** 2).sum())), i) for i, v in rows if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(got)]
    return out


def test_footrule():
    rnd = np.random.default_rng(0)
    order = np.array([rnd.permutation(12)[:5] for _ in range(40)])
    files = P.InvertedFiles(order, 12)
    for q in order[:6]:
        place = lambda o, p: o.tolist().index(p) if p in o else 5
        want = [sum(abs(place(q, p) - place(o, p)) for p in range(12)) for o in order]
        np.testing.assert_array_equal(files.footrule(q), want)


def test_recall_and_exact_scores(spark):
    df = table(spark, SF01, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {(q, i): d for q, _, i, d in slow(rows, 10, 20)}
    got = P.search(df, every=20, block=250, candidates=40).collect()
    assert len(got) == len(want)
    hit = [r for r in got if (r.query_id, r.vec_id) in want]
    assert len(hit) >= 0.9 * len(want)
    for r in hit:
        assert r.score == pytest.approx(want[r.query_id, r.vec_id], abs=1e-12)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    for g in by.values():
        g.sort()
        assert [x[0] for x in g] == list(range(1, len(g) + 1)) and [x[1:] for x in g] == sorted(x[1:] for x in g)


def test_production_parameters_rank_by_footrule(spark):
    df = table(spark, SF01, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert len(rows) > P.CANDIDATES  # the block is not reranked whole
    want = {(q, i) for q, _, i, _ in slow(rows, 10, 100)}
    got = [(r.query_id, r.vec_id) for r in P.search(df).collect()]
    assert len(got) == len(want) and len(want & set(got)) >= 0.9 * len(want)


def test_candidates_are_those_of_least_footrule():
    rnd = np.random.default_rng(2)
    x, pivots, ids = rnd.normal(size=(300, 6)), rnd.normal(size=(20, 6)), rnd.permutation(300)
    block = P.Block(ids, x, pivots, 8)
    order = [np.argsort(((v - pivots) ** 2).sum(axis=1), kind="stable")[:8].tolist() for v in x]
    place = lambda o, p: o.index(p) if p in o else 8
    for i in range(0, 300, 37):
        far = [sum(abs(place(order[i], p) - place(o, p)) for p in range(20)) for o in order]
        limit = sorted(far)[30]
        near = [(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), ids[j]) for j in range(300) if far[j] <= limit and j != i]
        q, found, d = block.nearest(ids[i:i + 1], x[i:i + 1], 5, 30)
        assert found.tolist() == [j for _, j in sorted(near)[:5]] and set(q) == {ids[i]}


def test_a_row_repeated_thousands_of_times(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=4).round(2).tolist()) for i in range(1, 121)] + [(7, [2.0, 2.0, 2.0, 2.0])] * 3000 + [(200, [2.0, 2.0, 2.0, 1.75])] * 3000
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in P.search(df, share=1.0).collect())
    assert got == [w[:3] for w in slow(rows, 10, 100)]


def test_few_rows_are_exact(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.integers(1, 4, 3).astype(float).tolist()) for i in range(250)] + [(100, [1.0, 1.0, 1.0]), (41, [0.5, 0.25, 0.0]), (41, [0.5, 0.25, 0.0])]
    bad = [(None, [1.0, 1.0, 1.0]), (300, None), (400, [1.0, None, 2.0]), (500, [float("nan")] * 3), (600, [float("inf"), 0.0, 0.0]), (700, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in P.search(df).collect())
    assert [g[:3] for g in got] == [w[:3] for w in slow(rows, 10, 100)]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in slow(rows, 10, 100)])
    assert P.search(df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0], 1, ""), (3, [2.0], 1, "")], SCHEMA)
    assert [tuple(r) for r in P.search(few).collect()] == [(0, 1, 3, 1.0)]
    with pytest.raises(ValueError):
        P.search(spark.createDataFrame([(0, [1.0], 1, ""), (3, [2.0, 1.0], 1, "")], SCHEMA))
