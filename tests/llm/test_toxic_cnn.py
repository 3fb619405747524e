"""Word rows, convolutions by hand, gradients, held-out accuracy and edge cases of the toxicity classifier."""

import zlib

import numpy as np
import pyarrow as pa

from kohort.llm import toxic_cnn as M
from kohort.llm.common import table
from tests.conftest import SF01

SCHEMA = "doc_id long, text string, lang string, score string, label int, x int"


def test_word_rows_do_not_depend_on_their_neighbours():
    texts = [b"", b"One two, three", b"...", "é-ü".encode(), b"w " * 900_000, b"End"]
    rows, n_of = M.word_rows(texts)
    assert n_of.tolist() == [0, 3, 0, 2, 900_000, 1]
    np.testing.assert_array_equal(rows, np.concatenate([M.word_rows([t])[0] for t in texts]))
    np.testing.assert_array_equal(M.word_rows([b"ONE"])[0], M.word_rows([b"one"])[0])


def slow_score(model, rows):
    x = [sum(model["T"][i] for i in r) for r in rows] + [np.zeros(M.DIM)] * (M.WIDTHS[-1] - 1)
    pooled = []
    for w in M.WIDTHS:
        y = [sum(x[i + j] @ model[f"W{w}"][j] for j in range(w) if i + j < len(x)) for i in range(len(x))]
        pooled.append(np.maximum(np.max(y, axis=0) + model[f"k{w}"], 0))
    return 1 / (1 + np.exp(-(np.concatenate(pooled) @ model["c"] + model["b"])))


def test_scores_against_loops(monkeypatch):
    model = M.start(1)
    texts = [b"", b"a", b"b c", b"d e f g h", b"q w e r t y u i o p " * 4]
    rows, n_of = M.word_rows(texts)
    ends = np.cumsum(n_of)
    want = [slow_score(model, rows[e - n:e]) for e, n in zip(ends, n_of)]
    np.testing.assert_allclose(M.score(model, rows, n_of), want, rtol=1e-4)
    monkeypatch.setattr(M, "STEP_WORDS", 4)
    np.testing.assert_allclose(M.score(model, rows, n_of), want, rtol=1e-4)


def test_gradients_match_differences():
    model = {k: v.astype(np.float64) for k, v in M.start(2).items()}
    rows, n_of = M.word_rows([b"a b c d", b"e f", b"g h i j k"])
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.5, 2.0])

    def loss(m):
        y = M.forward(m, rows, n_of)[0]
        return -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).mean()

    _, g, _, _ = M.gradients(model, rows, n_of, label, weight)
    for k in ("c", "W2", "W3", "k1"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        d = np.zeros_like(model[k])
        d[at] = 1e-3
        want = (loss(model | {k: model[k] + d}) - loss(model | {k: model[k] - d})) / 2e-3
        np.testing.assert_allclose(g[k][at], want, rtol=0.02, atol=1e-5)


def test_thresholds():
    y, t = np.array([0.9, 0.8, 0.3, 0.2, 0.1]), np.array([1.0, 1.0, 0.0, 1.0, 0.0])
    cuts = M.thresholds(y, t, ["en", "en", "en", None, None])
    assert cuts == {None: cuts[None], "en": cuts[None]} and 0.1 < cuts[None] < 0.2


def test_held_out_accuracy_and_columns(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    got = {r.doc_id: r for r in M.digest(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    bad, good = ([g.score for t, g in held if t == k] for k in (1, 0))
    assert np.mean(np.subtract.outer(bad, good) > 0) > 0.6, (np.mean(bad), np.mean(good))  # some 20 toxic documents to learn from


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "en", "s", 1, 1), (2, "", None, "s", 1, 1), (None, "a b", "en", "s", 0, 1), (3, "q " * 50_000, "xx", "s", 0, 1),
                                (3, "same", "en", None, None, 1), (3, "same", "en", None, None, 1)], SCHEMA)
    schema = "doc_id long, quality int, toxic int"
    assert {r.score for r in M.digest(df, spark.createDataFrame([], schema)).collect()} == {0.5}
    both = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (2, 1, None), (None, 1, 1)], schema)
    got = {(r.doc_id, r.n_words): r.score for r in M.digest(df, both).collect()}
    assert len(got) == 5 and got[1, 0] == got[2, 0]
    assert M.digest(df.limit(0), both).collect() == []


def test_gradients_of_long_texts_do_not_depend_on_the_parts(monkeypatch):
    model = M.start(4)
    texts = [b"a b c d", b"e f g h i j k l m n o p q r s t u v w x y z", b"aa bb", b"cc dd ee ff gg hh ii jj kk ll"]
    rows, n_of = M.word_rows(texts)
    label, weight = np.array([1.0, 0.0, 1.0, 1.0]), np.array([1.0, 0.5, 2.0, 1.0])

    def table(hit, d):
        out = np.zeros((M.ROWS, M.DIM))
        np.add.at(out, hit.ravel(), np.repeat(d, hit.shape[1], axis=0))
        return out

    _, want, *hits = M.gradients(model, rows, n_of, label, weight)
    monkeypatch.setattr(M, "STEP_WORDS", 4)
    got, *own = M._batch_gradients(model, rows, n_of, label, weight)
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-4, atol=1e-7)
    np.testing.assert_allclose(table(*own), table(*hits), rtol=1e-4, atol=1e-7)


def test_long_documents_are_learnt_from(spark):
    """Only documents over 1,024 words are toxic; an id over the whole budget is passed over."""
    rnd = np.random.default_rng(1)
    fill = lambda n: " ".join(f"w{i}" for i in rnd.integers(0, 300, n))
    rows = [(i, fill(40 if i % 2 else 1500) + ("" if i % 2 else " poison poison"), "en", "s", 1, 1) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    assert "prior" not in M.train(docs, labels)[0]
    size = M.F.length("text")
    chosen = M.sample_ids(labels, "toxic", 3, 1, 100)
    some = [r.doc_id for r in M.sample_within(docs, chosen, size, 100, 50_000).collect()]
    lengths = {r[0]: len(r[1]) for r in rows}
    order = [r.doc_id for r in chosen.collect()]
    assert some == order[:len(some)] and sum(lengths[i] for i in some) <= 50_000 < sum(lengths[i] for i in order[:len(some) + 1])
    assert all(i % 2 for i in (r.doc_id for r in M.sample_within(docs, chosen, size, 100, 4000).collect()))


def test_all_labelled_documents_are_learnt_from(spark, monkeypatch):
    """The first FIT_ROWS ids hold no toxic document; the others do, and count."""
    for k, v in {"FIT_ROWS": 40, "SHARDS": 2, "ROUNDS": 12, "REFINE_RATE": 0.02}.items():
        monkeypatch.setattr(M, k, v)
    rnd = np.random.default_rng(2)
    flat = spark.createDataFrame([(i, 1, 0) for i in range(900)], "doc_id long, quality int, toxic int")
    first = {r.doc_id for r in M.sample_ids(flat, "toxic", 3, 1, 40).collect()}
    toxic = [int(i % 3 == 0 and i not in first) for i in range(900)]
    rows = [(i, " ".join(f"w{j}" for j in rnd.integers(0, 50, 12)) + (" poison" if toxic[i] else ""), "en" if i % 2 else None, "s", 1, 1) for i in range(900)]
    docs = spark.createDataFrame(rows + rows[:5], SCHEMA)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    usable = [r[0] for r in rows + rows[:5] if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    held = M.packed(docs, labels).collect()
    assert sum(len(r.n_of) for r in held) == len(usable) and sum(sum(r.label) for r in held) == sum(toxic[i] for i in usable)
    got = {r.doc_id: r for r in M.digest(docs, labels).collect()}
    bad, good = ([got[i].score for i in range(900) if toxic[i] == k and got[i].held_out] for k in (1, 0))
    assert np.mean(np.subtract.outer(bad, good) > 0) > 0.95
    model, cuts = M.train(docs, labels)
    assert "prior" not in model and 0 < cuts[None] < 1


def test_counted_thresholds(spark):
    """As the thresholds of all scores, up to a step."""
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 11} c", "en" if i % 3 else "xx", "s", 1, 1) for i in range(800)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 7 < 3)) for i in range(800)], "doc_id long, quality int, toxic int")
    held, model = M.packed(docs, labels), M.start(3)
    got = M._counted_thresholds(held, model)
    y, t, lang = [], [], []
    for n_of, label, aside, langs, rows in M._blocks([pa.RecordBatch.from_pylist([r.asDict()]) for r in held.collect()]):
        y.append(M.score(model, rows, n_of)[aside])
        t.append(label[aside])
        lang += [v for v, a in zip(langs, aside) if a]
    want = M.thresholds(np.concatenate(y), np.concatenate(t), lang)
    assert set(got) == {None, *(k for k in want if sum(x for x, v in zip(np.concatenate(t), lang) if v == k) >= M.CALIBRATE_TOXIC)}
    assert all(abs(got[k] - want[k]) <= 1 / M.CELLS for k in got), (got, want)


def test_driver_gets_only_the_weights(spark, monkeypatch):
    """Neither the first documents nor every shard's weights come to the driver; it does not fit."""
    monkeypatch.setattr(M, "FIT_ROWS", 40)
    monkeypatch.setattr(M, "fit", None)  # tasks import their own
    docs = spark.createDataFrame([(i, f"a{i % 5} b{i % 7}" + (" poison" if i % 2 else ""), "en", "s", 1, 1) for i in range(300)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    sizes = []

    def collect(self, real=type(docs).collect):
        rows = real(self)
        sizes.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(docs), "collect", collect)
    model, _ = M.train(docs, labels)
    assert "prior" not in model and max(sizes) == 4 * sum(v.size for v in model.values())
