"""Repeated bytes against brute force over all windows; suffix arrays, groups and edge cases."""

import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from kohort.llm import repeats as R
from kohort.llm import repeats_kernel as K
from kohort.llm.common import table
from tests.conftest import SF001


def slow(texts, length):
    """Per text (bytes, removed, spans, kept digest)."""
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            places[t[a:a + length]].append((i, a))
    gone = [np.zeros(len(t), bool) for t in texts]
    for at in places.values():
        if len(at) > 1:
            for i, a in at:
                gone[i][a:a + length] = True
    out = []
    for t, g in zip(texts, gone):
        spans = int((np.diff(np.concatenate(([0], g.astype(np.int8)))) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~g])
        out.append((len(t), int(g.sum()), spans, sha256(kept).hexdigest()))
    return out


def check(df, length, **more):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    want = sorted(((i, *x) for (i, _), x in zip(rows, slow([t for _, t in rows], length))), key=str)
    assert sorted((tuple(r) for r in R.digest(df, length, **more).collect()), key=str) == want


def made(seed, n, alphabet="ab é", words=9):
    """Texts of shared passages, copies, runs and noise."""
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice(alphabet + "cdefgh") for _ in range(rnd.randrange(40, 400))) for _ in range(words)]
    out = []
    for _ in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choice("xyzuvw qrst") for _ in range(rnd.randrange(1, 200))) for _ in range(rnd.randrange(1, 6))]
        out.append("".join(parts) if rnd.random() < 0.9 else "".join(rnd.choice(passages)[:rnd.randrange(1, 8)] * 60))
    return out


def test_blocks_hold_every_window_once_and_agree():
    texts = [t.encode() for t in made(1, 30)] + [b"", b"x" * 199, b"y" * 200, b"ab" * 700]
    text, start, windows, _, mh, sh = K.blocks(texts, 64)
    seen, anchors = set(), {}
    for i, a, n, m, s in zip(text.tolist(), start.tolist(), windows.tolist(), mh.tolist(), sh.tolist()):
        for w in range(a, a + n):
            seen.add((i, w))
            assert anchors.setdefault(texts[i][w:w + 64], m) == m
    assert seen == {(i, a) for i, t in enumerate(texts) for a in range(len(t) - 63)}


def test_long_texts_are_cut_into_parts(monkeypatch):
    texts = [t.encode() for t in made(2, 10)]
    monkeypatch.setattr(K, "SEGMENT", 256)
    text, start, windows, _, mh, sh = K.blocks(texts, 64)
    assert windows.sum() == sum(max(0, len(t) - 63) for t in texts)


def test_suffix_array_intervals():
    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randrange(12, 60))) for _ in range(12)] + [b"ab" * 20]
    windows = np.array([len(t) - 7 for t in texts])
    sa = K.EnhancedSuffixArray(texts, windows, 8)
    got = {(size, frozenset(zip(sa.block[sa.order[a:b + 1]].tolist(), sa.offset[sa.order[a:b + 1]].tolist()))) for size, a, b in sa.maximal_repeats().tolist()}
    for size, at in got:  # each is a repeat, and the first window or a byte to the left tells its occurrences apart
        assert len({texts[i][o:o + size] for i, o in at}) == 1 and size >= 8 and len(at) > 1
        assert any(o == 0 for _, o in at) or len({texts[i][o - 1] for i, o in at}) > 1
    places = defaultdict(set)
    for i, t in enumerate(texts):
        for a in range(len(t) - 7):
            places[t[a:a + 8]].add((i, a))
    covered = {(i, o + k) for size, at in got for i, o in at for k in range(size)}
    assert covered == {(i, a + k) for at in places.values() if len(at) > 1 for i, a in at for k in range(8)}
    block, first, end = sa.covered()
    assert {(i, k) for i, a, e in zip(block.tolist(), first.tolist(), end.tolist()) for k in range(a, e)} == covered


def test_given_documents(spark):
    check(table(spark, SF001, "documents"), 200)


def test_made_texts(spark):
    rows = [(i, t, "r", 1, 2) for i, t in enumerate(made(7, 120))]
    rows += [(500, rows[3][1], "r", 1, 2), (500, rows[3][1], "r", 1, 2), (None, rows[5][1], "r", 1, 2), (None, None, "r", 1, 2), (501, None, "r", 1, 2),
             (502, "", "r", 1, 2), (503, "z" * 5000, "r", 1, 2), (504, "é" * 150, "r", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n_bytes long, did int")
    check(df, 200)
    check(df, 200, hot=3)
    check(df, 200, hot=1)
    assert R.digest(df.limit(0)).collect() == []


def test_groups_cover_what_the_digest_removes(spark):
    rows = list(enumerate(made(9, 40)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    want = {r.doc_id: r.n_removed for r in R.digest(df).collect() if r.n_removed}
    for hot in (R.HOT, 1):
        groups, gone = defaultdict(set), defaultdict(set)
        for r in R.repeat_groups(df, hot=hot).collect():
            groups[r.anchor, r.group].add(texts[r.did].encode()[r.start:r.start + r.size])
            gone[r.did] |= set(range(r.start, r.start + r.size))
        assert groups and all(len(g) == 1 for g in groups.values())
        assert {i: len(g) for i, g in gone.items()} == want


def test_groups_do_not_depend_on_the_number_of_blocks(spark):
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh ijkl") for _ in range(n))
    shared, end = noise(230), noise(40)
    rows = list(enumerate(made(9, 40) + [noise(30) + shared + (end if i % 3 == 0 else "") + noise(30) for i in range(60)] + [shared, shared[:205], shared + end]))
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def groups(hot):
        at = defaultdict(set)
        for r in R.repeat_groups(df, hot=hot).collect():
            at[r.anchor, r.group].add((r.size, r.did, r.start))
        return sorted(sorted(g) for g in at.values())

    want = groups(R.HOT)
    assert any(len(g) >= 62 for g in want)
    assert groups(3) == want and groups(1) == want


def test_without_repeats(spark):
    long = "".join(random.Random(1).choice("abcdefgh ij") for _ in range(300))
    rows = [(1, "first " + long + " end é", "en", 99), (2, long, "en", 300), (3, "untouched", "en", 9), (4, None, "en", 0), (5, " ", "en", 1), (6, "x" + long, None, 301)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars long")
    got = {r.doc_id: r for r in R.without_repeats(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and (got[2].text, got[2].n_chars) == ("", 0) and got[1].text == "first  end é" and got[1].n_chars == 12 and got[6].text == "x"
    assert (got[3].text, got[3].n_chars, got[4].text, got[5].text) == ("untouched", 9, "", " ")


def test_many_equal_rows(spark):
    text = "".join(random.Random(6).choice("abcdefgh ijkl") for _ in range(600))
    rows = [(7, text)] * 5000 + [(7, text[:300] + "x" + text[300:]), (8, "own " + text[100:350]), (None, text), (None, text), (7, "short"), (7, "short"), (9, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, 200)
    groups = R.repeat_groups(df).collect()
    assert {r.did for r in groups} == {7, 8, None} and max(r.copies for r in groups if r.did == 7) == 5000 and {r.copies for r in groups if r.did is None} == {2}
    out = R.without_repeats(df.select("*", F.lit(1).alias("copies"), F.lit(2).alias("_0"), F.lit("z").alias("found")))
    assert out.columns == ["doc_id", "text", "copies", "_0", "found"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    kept = {(i, h): n for i, n, _, _, h in R.digest(df).collect()}
    assert len(got) == len(rows) and {r[2:] for r in got} == {(1, 2, "z")}
    assert {(i, sha256((t or "").encode()).hexdigest()) for i, t, *_ in got} == set(kept)


def test_offsets_join_to_ranges(spark):
    df = spark.createDataFrame([([0],), ([3, 4, 5],), ([0, 1, 201, 402, 500],), ([10, 210, 411],)], "o array<long>")
    got = [[(x.first, x.end) for x in r.r] for r in df.select(R._joined_windows(200).alias("r")).collect()]
    assert got == [[(0, 200)], [(3, 205)], [(0, 401), (402, 700)], [(10, 410), (411, 611)]]
