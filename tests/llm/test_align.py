"""Alignment of two tokenizers against brute force over all token pairs."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

import public_tokenizers
from kohort.llm import align
from kohort.llm.common import table
from tests.conftest import SF001

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, block int, pair string"


@pytest.fixture(scope="module")
def tok():
    return align.tokenizers(A, B, public_tokenizers.PATTERN)


def tokenized(texts):
    """Per text the (id, bytes) of both tokenizers, by the libraries, or nothing."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {c: x for c, x in align._byte_of().items()}
    assert ByteLevel().decode(["Ġ"]) == " " and byte_of["Ġ"] == 0x20
    out = []
    for t in texts:
        want = b" " + (t or "").encode()
        x = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + (t or ""), add_special_tokens=False).ids]
        y = []
        for i in b.encode(t or ""):
            p = b.id_to_piece(i)
            y.append((i, bytes((int(p[3:5], 16),)) if b.is_byte(i) else p.replace("▁", " ").encode()))
        fits = t and all(b"".join(p for _, p in z) == want for z in (x, y))
        out.append((x, y) if fits else ([], []))
    return out


def slow(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)."""
    docs = []
    for x, y in tokenized(texts):
        spans = []
        for z in (x, y):
            at, s = 0, []
            for i, p in z:
                s.append((i, at, at + len(p)))
                at += len(p)
            spans.append(s)
        links, k = [], 0
        for i, s, e in spans[0]:
            while k and spans[1][k - 1][2] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] < e:
                if spans[1][k][2] > s:
                    links.append((i, spans[1][k][0]))
                k += 1
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, at = [], [0, 0]
        for e in ends:
            ids = [[], []]
            for side, z in enumerate(spans):
                while at[side] < len(z) and z[at[side]][2] <= e:
                    ids[side].append(str(z[at[side]][0]))
                    at[side] += 1
            groups.append("|".join(map(",".join, ids)))
        docs.append((len(x), len(y), len(ends), links, ";".join(groups)))
    count = Counter(p for d in docs for p in set(d[3]))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return [(na, nb, ng, len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls), sha256(g.encode()).hexdigest() if g else "") for na, nb, ng, ls, g in docs]


def check(rows, df, *options):
    want = sorted(((i, *x) for (i, _), x in zip(rows, slow([t for _, t in rows]))), key=str)
    for more in options or ({},):
        assert sorted((tuple(r) for r in align.digest(df, A, B, public_tokenizers.PATTERN, **more).collect()), key=str) == want


ODD = [None, "", " ", "  two  spaces ", "tabs\t\tand\nlines\r\n", "▁ is the piece sign", "a<|endoftext|>b", "<s> <unk> <0x41>", "naïve Straße ÉCOLE", "日本語のテキスト", "🙂👩‍👩‍👧", " ​﻿",
       "x" * 5000, "0123456789" * 300, "a\0b", "don't they'll", " " * 300 + "x", "ends with space ", "\n"]


def test_given_documents(spark):
    docs = table(spark, SF001, "documents")
    check([(r.doc_id, r.text) for r in docs.collect()], docs, {}, {"block_bytes": 20_000})


def test_odd_texts_and_repeated_rows(spark):
    rows = [(i if i % 4 else None, t) for i, t in enumerate(ODD)] + [(7, "the same row"), (7, "the same row"), (7, "another text"), (None, "the same row")]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)
    check(rows, df)
    assert align.digest(df.limit(0), A, B, public_tokenizers.PATTERN).collect() == []


def test_lanes_change_nothing(tok):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["the ", "Straße", "  ", "日本", "xq", "ing ", "\n", "7", "é"]) for _ in range(n)) for n in (0, 3, 400, 4000)] + ["z" * 3000]
    got = align.Aligned(tok, texts)
    whole = align.lockstep(got.end_a, got.end_b, align.lanes(got.end_a, got.end_b, got.first_a, got.first_b, 1 << 30))
    for most in (1, 5, 100):
        lane = align.lanes(got.end_a, got.end_b, got.first_a, got.first_b, most)
        assert lane.shape[1] > 5 and (lane[0] < lane[1]).all() and (lane[2] < lane[3]).all()
        parts = align.lockstep(got.end_a, got.end_b, lane)
        assert sorted(zip(*parts[:2])) == sorted(zip(*whole[:2]))
        assert all(np.array_equal(x, y) for x, y in zip(parts[2:], whole[2:]))


def test_both_engines_of_a_agree(tok):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    assert tok.fast is not None
    rnd = random.Random(4)
    texts = [t for t in ODD if t] + ["".join(chr(rnd.choice([rnd.randrange(0x20, 0x7F), rnd.randrange(0xA0, 0x3000), rnd.randrange(0xE000, 0x1FFFF), 0x20, 0x0A])) for _ in range(200)) for _ in range(300)]
    for t in texts:
        assert tok.fast.encode_ordinary(" " + t) == tok.ids_a(t) == lib.encode(" " + t, add_special_tokens=False).ids
    long = "a " + " " * 400_000 + "b"  # more white space than the quicker engine takes
    assert tok.ids_a(long) == lib.encode(" " + long, add_special_tokens=False).ids


def test_alignments_give_links_and_cuts(spark, tok):
    rows = [(1, "naïve Straße in the thonre"), (2, None), (None, "  two")]
    got = {r.doc_id: r for r in align.alignments(spark.createDataFrame(rows, "doc_id long, text string"), A, B, public_tokenizers.PATTERN).collect()}
    assert got[2].a_ids == got[2].b_ids == got[2].links == got[2].cuts == []
    for i, t in rows:
        if t:
            r = got[i]
            ea, eb = np.cumsum(tok.size_a[r.a_ids]), np.cumsum(tok.size_b[r.b_ids])
            sa, sb = ea - tok.size_a[r.a_ids], eb - tok.size_b[r.b_ids]
            assert [(x.a, x.b) for x in r.links] == [(x, y) for x in range(len(ea)) for y in range(len(eb)) if sa[x] < eb[y] and sb[y] < ea[x]]
            assert r.cuts == sorted(set(ea.tolist()) & set(eb.tolist())) and r.cuts[-1] == len(t.encode()) + 1


def test_blocks_hold_a_megabyte_of_text(spark):
    """A task's arrays follow its block, so blocks stay small whatever the partition holds."""
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 5000) for i in range(30)], "doc_id long, text string").coalesce(1)
    assert align.blocks(docs, A, B, public_tokenizers.PATTERN).count() >= 3
