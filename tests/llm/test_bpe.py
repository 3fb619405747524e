"""The rank queue against tiktoken, and exact round trips."""

import base64
import random
from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken

from kohort.llm import bpe
from kohort.llm.common import table
from tests.conftest import SF001

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_texts(own, library):
    rnd = random.Random(1)
    texts = ["", " ", "\n\n \t x", "aaaaaaa" * 50, "ab" * 3000, "naïve Ünïcode 😀😀", "a\x00b", "'s 're it's", "<|endoftext|>",
             "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2000), rnd.randrange(0x1F300, 0x1F600)])) for _ in range(3000)),
             "".join(rnd.choice("abeinrst") for _ in range(60_000)), "=" * 20_000, " " * 5000 + "x"]
    texts += ["".join(rnd.choice("aab éñß") for _ in range(rnd.randrange(1, 60))) for _ in range(500)]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_both_splitters_agree(own):
    import regex
    slow = regex.compile(P.PATTERN).findall
    rnd = random.Random(2)
    near = [chr(c) for c in range(0x250)]
    for _ in range(3000):
        t = "".join(rnd.choice(near if rnd.random() < 0.5 else "ab1 '\n.") for _ in range(40))
        assert own.split_near(t) == slow(t)


def test_generations_keep_results(library):
    small = bpe.codec(PATH, P.PATTERN, 3)
    assert small.cache_entries == 3 and small is not bpe.codec(PATH, P.PATTERN)
    for t in ("one two three four five six seven " * 5, "one two eight nine", "three four"):
        assert small.encode(t) == library.encode_ordinary(t) and (small.old is not None)


def test_given_documents(spark, library):
    docs = table(spark, SF001, "documents")
    want = {r.doc_id: library.encode_ordinary(r.text) for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.digest(docs, PATH, P.PATTERN).collect()
    assert len(got) == len(want)
    for r in got:
        ids = ",".join(map(str, want[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), sha256(ids.encode()).hexdigest())
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
    encoded = bpe.encode(docs, PATH, P.PATTERN)
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded, PATH, P.PATTERN).collect()} == {i: t.encode() for i, t in texts.items()}


def test_edges(spark):
    schema = "doc_id long, text string, ids string, n_tokens int"
    df = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (None, "a", None, 2), (3, "a", "", 0), (3, "a", "", 0)], schema)
    empty = sha256(b"").hexdigest()
    got = sorted(map(tuple, bpe.digest(df, PATH, P.PATTERN).collect()), key=str)
    assert [g[:2] for g in got] == [(1, 0), (2, 0), (3, 1), (3, 1), (None, 1)]
    assert got[0][2:] == (empty, empty)
    assert bpe.digest(df.limit(0), PATH, P.PATTERN).collect() == []
    assert sorted((r.ids or []) != [] for r in bpe.encode(df, PATH, P.PATTERN).collect()) == [False, False, True, True, True]
