"""The automaton against brute force over all template substrings; spans and edge cases."""

import random
import re

from kohort.llm import license_scan as L
from kohort.llm.common import table
from tests.conftest import SF001

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def slow_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_base(text):
    w = slow_words(text)
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def check(rows, got):
    assert sorted((r.doc_id, *slow_base(r.text)) for r in rows) == sorted((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got)
    for g in got:
        assert 0 <= g.score <= 1 and set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(",")))


def test_given_documents(spark):
    docs = table(spark, SF001, "documents")
    got = L.digest(docs).collect()
    check(docs.collect(), got)
    by = {r.doc_id: r for r in got}
    for r in docs.collect():
        assert ("cc-by-nc" in by[r.doc_id].labels.split(",")) == ("licensed under cc by-nc 4.0" in r.text.lower())


def test_matching_statistics():
    a = L.Automaton()
    subs = {tuple(s[i:j]) for s in a.sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    rnd = random.Random(4)
    vocabulary = sorted({w for s in a.sequences for w in s}) + [b"x"]
    for _ in range(200):
        words = []
        while len(words) < 40:
            s = rnd.choice(a.sequences)
            i = rnd.randrange(len(s))
            words += s[i:i + rnd.randrange(1, 8)] if rnd.random() < 0.6 else [rnd.choice(vocabulary)]
        longest = [max((n for n in range(0, i + 2) if not n or tuple(words[i + 1 - n:i + 1]) in subs)) for i in range(len(words))]
        want = [(i + 1, longest[i]) for i in range(len(words)) if longest[i] >= L.MIN_MATCH and (i + 1 == len(words) or longest[i + 1] != longest[i] + 1)]
        base, matches = a.stream(words)
        assert [(e, l) for e, l, _ in matches if l >= L.MIN_MATCH] == want
        w = [x.decode() for x in words]
        assert len(base) == sum(w[i:i + len(p.split())] == p.split() for p in PHRASES for i in range(len(w)))


def test_chains_bridge_gaps():
    a = L.Automaton()
    whole = L.TEMPLATES[0][0]
    got = a.scan(("x y " + whole + " z").encode())
    assert got["labels"] == "mit" and got["score"] == 1 and {"label": "mit", "first": 2, "end": 2 + len(whole.split())} in got["spans"]
    w = whole.split()
    changed = " ".join(w[:8] + ["very", "other"] + w[9:])
    got = a.scan(changed.encode())
    assert got["labels"] == "mit" and 0.8 < got["score"] < 1
    far = " ".join(w[:5] + ["gap"] * 30 + w[15:])
    assert a.scan(far.encode())["labels"] == ""


def slow_best(a, matches, template):
    """The most words any chain of the template covers: all chains tried, one fragment after another."""
    frags = [(e - l, e, o, l) for e, l, s in matches for t, o in a.places[s] if t == template]

    def after(f):
        return max((min(g[3], g[1] - f[1], g[2] - f[2]) + after(g) for g in frags
                    if g[1] > f[1] and g[2] > f[2] and g[0] - f[1] <= L.MAX_GAP), default=0)
    return max((f[3] + after(f) for f in frags), default=0)


def test_chains_against_all_chains():
    a = L.Automaton(base=(("a b", "base"),), templates=(("a b c d e f g h a b c i j", "x"), ("c d e a b c d e a b", "y"), ("g h i j k l m", "z")))
    rnd = random.Random(8)
    seen = set()
    for _ in range(300):
        words = []
        while len(words) < rnd.randrange(5, 45):
            seq = rnd.choice(a.sequences)
            i = rnd.randrange(len(seq))
            words += seq[i:i + rnd.randrange(1, 7)] if rnd.random() < 0.7 else [b"stray"] * rnd.randrange(1, 11)
        _, matches = a.stream(words)
        got = a.chains(matches)
        for t, seq in enumerate(a.sequences):
            best = max((share for u, share, _, _ in got if u == t), default=0)
            assert best == slow_best(a, matches, t) / len(seq)
            seen.add(round(best, 1))
        assert all(0 <= first < end <= len(words) and 0 < share <= 1 for _, share, first, end in got)
    assert len(seen) > 8


def test_stray_pieces_break_no_chain():
    a = L.Automaton()
    mit, bsd = L.TEMPLATES[0][0].split(), L.TEMPLATES[8][0].split()
    got = a.scan(" ".join(mit[:8] + mit[15:18] + mit[8:]).encode())
    assert got["score"] == 1 and {"label": "mit", "first": 0, "end": len(mit) + 3} in got["spans"]
    got = a.scan(" ".join(bsd[:5] + bsd[-3:] + bsd[5:]).encode())
    assert got["score"] == 1 and got["labels"] == "bsd"
    # a notice that is given twice is two spans
    got = a.scan(" ".join([*bsd, "x", *bsd]).encode())
    assert got["spans"] == [{"label": "bsd", "first": 0, "end": len(bsd)}, {"label": "bsd", "first": len(bsd) + 1, "end": 2 * len(bsd) + 1}]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "-- .,!"), (4, "MIT License mit\nLICENSE"), (4, "MIT License mit\nLICENSE"), (5, "mit licenseé mit-license"),
            (6, "gnu general public license " * 30_000), (7, "İ mit license K apache\x00license")]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, score int, labels string")
    got = L.digest(df).collect()
    check(df.collect(), got)
    assert {(g.labels, g.score) for g in got if g.doc_id < 4} == {("", 0.0)}
    assert L.digest(df.limit(0)).collect() == []
