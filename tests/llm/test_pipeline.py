"""The pipeline against its stages by brute force, and its edge cases."""

from collections import Counter, defaultdict

import public_tokenizers as P
import tiktoken  # noqa: F401  (its presence is what test_bpe compares with)

import __spark_entry__ as E
import corpus_pipeline as C
from kohort.llm import bpe, mil_quality
from kohort.llm.common import table
from tests.conftest import SF001
from tests.llm.test_mixing import size
from tests.llm.test_repeats import slow as slow_repeats
from tests.llm.test_simhash import slow_components, slow_fingerprint


def test_stages_by_brute_force(spark):
    docs = table(spark, SF001, "documents")
    cols = docs.columns
    rows = docs.collect()
    texts = {r.doc_id: r.text for r in rows}

    kept = C.quality(spark, docs, SF001).cache()
    score = {r.doc_id: r.predicted for r in mil_quality.digest(docs, table(spark, SF001, "labels")).collect()}
    assert kept.columns == cols
    first = {r.doc_id: r.text for r in kept.collect()}
    assert first == {i: t for i, t in texts.items() if score[i]}

    apart = C.near_duplicates(spark, kept, SF001).cache()
    ids = sorted(first)
    comp = slow_components([(i, slow_fingerprint(first[i])) for i in ids])
    second = {r.doc_id: r.text for r in apart.collect()}
    assert apart.columns == cols and second == {i: first[i] for i, c in zip(ids, comp) if i == c}

    cut = C.repeated_passages(spark, apart, SF001).cache()
    want = dict(zip(second, slow_repeats([t.encode() for t in second.values()], 200)))
    third = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == cols
    for i, (n, gone, _, digest) in want.items():
        from hashlib import sha256
        if not gone:
            assert third[i].text == second[i] and third[i].n_chars == len(second[i])
        elif i in third and "�" not in third[i].text:
            assert sha256(third[i].text.encode()).hexdigest() == digest and third[i].n_chars == len(third[i].text)

    mixed = C.mix(spark, cut, SF001).cache()
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r.doc_id] += size(r.text)
    assert mixed.columns == cols and all(taken[i] <= 3 * size(third[i].text) for i in taken)

    own = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    last = C.tokens(spark, mixed, SF001).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in last) == Counter((r.doc_id, tuple(own.encode(r.text))) for r in mixed.collect())


def test_run_is_the_stages_in_turn_and_agrees_with_itself(spark):
    digest = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    got = digest(E.queries()["pipeline"](spark, SF001))
    assert got and got == digest(C.run(spark, SF001))


def test_edges(spark, tmp_path):
    rows = [(1, None, "en", "a", 0, 5), (2, "", "en", "a", 0, 5), (3, "w " * 30_000, None, None, 60_000, 5), (4, "one two three", "en", "b", 13, 5),
            (4, "one two three", "en", "b", 13, 5), (None, "no id here", "en", "b", 10, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = df
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    assert {r.doc_id for r in C.tokens(spark, docs, str(tmp_path)).collect()} <= {3, 4, None}
    empty = df.limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
