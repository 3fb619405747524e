"""Passage features, gradients, held-out accuracy and edge cases of the quality classifier."""

import math
import re
import zlib

import numpy as np

from kohort.llm import mil_quality as M
from kohort.llm import words
from kohort.llm.common import table
from tests.conftest import SF01

SCHEMA = "doc_id long, text string, score string, row string, label int, x int"


def test_passages_do_not_depend_on_their_neighbours():
    texts = [b"", b"one two three", b" \n ", b"w " * 500, "é ü ".encode() * 100, b"x" * 100, b"End\nOf"]
    x, n_of = M.passages(texts)
    assert n_of.tolist() == [1, 1, 1, 8, 4, 1, 1]
    alone = [M.passages([t])[0] for t in texts]
    np.testing.assert_allclose(x, np.concatenate(alone), atol=1e-6)
    assert not x[0].any()


def test_a_text_of_several_segments():
    text = b"word and more words here " * 100_000
    x, n_of = M.passages([b"a", text, b"b"])
    assert n_of[0] == n_of[2] == 1 and abs(n_of[1] - 500_000 / 64) <= len(text) / words.SEGMENT + 2 and len(x) == n_of.sum()


def test_gradients_match_differences():
    rnd = np.random.default_rng(0)
    x, n_of, label = rnd.normal(size=(9, 6)), np.array([2, 4, 3]), np.array([0.0, 1.0, 1.0])
    model = {"E": rnd.normal(size=(6, 5)), "e": rnd.normal(size=5), "V": rnd.normal(size=(5, 3)), "U": rnd.normal(size=(5, 3)),
             "w": rnd.normal(size=3), "c": rnd.normal(size=5), "b": np.array(0.1), "mean": np.zeros(6), "scale": np.ones(6)}

    def loss(m):
        y = M.forward(m, x, n_of)[0]
        return -(label * np.log(y) + (1 - label) * np.log(1 - y)).mean()

    g = M.gradients(model, x, n_of, label)
    for k in ("E", "e", "V", "U", "w", "c", "b"):
        at = np.unravel_index(rnd.integers(model[k].size), model[k].shape)
        d = np.zeros_like(model[k])
        d[at] = 1e-5
        want = (loss(model | {k: model[k] + d}) - loss(model | {k: model[k] - d})) / 2e-5
        np.testing.assert_allclose(np.asarray(g[k])[at], want, atol=1e-6)


def test_forward_by_loops():
    rnd = np.random.default_rng(1)
    x, n_of = rnd.normal(size=(8, 4)), np.array([3, 1, 4])
    m = {"E": rnd.normal(size=(4, 5)), "e": rnd.normal(size=5), "V": rnd.normal(size=(5, 3)), "U": rnd.normal(size=(5, 3)), "w": rnd.normal(size=3),
         "c": rnd.normal(size=5), "b": np.array(0.2), "mean": rnd.normal(size=4), "scale": rnd.uniform(1, 2, size=4)}
    want, at = [], 0
    for n in n_of:
        hidden, weight = [], []
        for row in x[at:at + n]:
            z = [(v - a) / s for v, a, s in zip(row, m["mean"], m["scale"])]
            h = [math.tanh(sum(z[i] * m["E"][i][j] for i in range(4)) + m["e"][j]) for j in range(5)]
            gate = 0.0
            for g in range(3):
                v, u = (sum(h[j] * m[k][j][g] for j in range(5)) for k in ("V", "U"))
                gate += m["w"][g] * math.tanh(v) / (1 + math.exp(-u))
            hidden.append(h)
            weight.append(math.exp(gate))
        at += n
        rep = [sum(w * h[j] for w, h in zip(weight, hidden)) / sum(weight) for j in range(5)]
        want.append(1 / (1 + math.exp(-sum(r * c for r, c in zip(rep, m["c"])) - float(m["b"]))))
    np.testing.assert_allclose(M.forward(m, x, n_of)[0], want, atol=1e-12)


def test_features_by_loops():
    """A passage's features, word by word and byte by byte."""
    texts = ["The cat, the the CAT sat; 42 internationalisation!", "é ü x " + "word " * 70, "  a  ", "One-two\tthree\n" * 30]
    x, n_of = M.passages([t.encode() for t in texts])
    at = 0
    for text, n in zip(texts, n_of):
        found = list(re.finditer(rb"[^\x20\x09-\x0D]+", text.encode()))
        assert n == -(-len(found) // M.PASSAGE_WORDS)
        for p in range(n):
            # equal up to case: bytes.lower() changes A-Z only
            part = [w.group().lower() for w in found[p * M.PASSAGE_WORDS:(p + 1) * M.PASSAGE_WORDS]]
            size = [len(w) for w in part]
            mean = sum(size) / len(size)
            want = [sum(a == b for a, b in zip(part, part[1:])) / len(part), len(set(part)) / len(part), math.log(1 + len(part)) / 4, mean / 10,
                    sum(s <= 2 for s in size) / len(size), sum(s > 14 for s in size) / len(size),
                    math.sqrt(max(0, sum(s * s for s in size) / len(size) - mean ** 2)) / 5]
            row = x[at + p]
            np.testing.assert_allclose(row[M.N_CLASSES + M.BUCKETS:], want, rtol=1e-4, atol=1e-4)
            np.testing.assert_allclose([row[:M.N_CLASSES].sum(), row[M.N_CLASSES:M.N_CLASSES + M.BUCKETS].sum()], 1, atol=1e-5)
            # words share a bucket or they do not: the bucket counts are those of the distinct words, merged
            counts = sorted(round(float(v) * len(part)) for v in row[M.N_CLASSES:M.N_CLASSES + M.BUCKETS] if v)
            assert sum(counts) == len(part) and len(counts) <= len(set(part))
        at += n


def test_held_out_accuracy_and_columns(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    got = {r.doc_id: r for r in M.digest(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([q == g.predicted for q, g in held]) > 0.93
    good, bad = ([g.score for q, g in held if q == k] for k in (1, 0))
    assert np.mean(np.subtract.outer(good, bad) > 0) > 0.95
    assert {r.doc_id for r in M.keep_good(docs, labels).select("doc_id").collect()} == {i for i, r in got.items() if r.predicted}


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "s", "r", 1, 1), (2, "", "s", "r", 1, 1), (None, "a b", "s", "r", 0, 1), (3, "q " * 50_000, "s", "r", 0, 1),
                                (3, "same", None, None, None, 1), (3, "same", None, None, None, 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = M.digest(df, labels).collect()
    assert len(got) == 6 and len({r.score for r in got}) == 1 and all(r.predicted == 1 for r in got)
    assert M.digest(df, labels.limit(0)).first().score == 0.5
    both = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = M.digest(df, both).collect()
    assert got[0].score == got[1].score and M.digest(df.limit(0), labels).collect() == []
    assert M.keep_good(df, both).columns == df.columns
