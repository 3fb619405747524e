"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's symbols form a linked list. Every adjacent pair that has a merge rank puts its
left position into the bucket of that rank, and the rank's bit is set in a two-level bitmap
(words of 256 ranks, and one bit a word above them). The next merge is found by
find-first-set down the levels; the bucket's leftmost position that is still current (both
symbols unchanged since it was filed) is merged, stale entries are skipped. A merge files at
most two new pairs, so a pre-token of n bytes takes O(n log n) steps however long it is.

Texts are cut by the pattern, each match is encoded on its own; encodings of short matches
are remembered in a cache of bounded size (two generations, so frequent ones stay).

Vocabularies are rank files of base64 tokens, given by path; every worker reads the file once
(ship it with the job, or install it on the nodes). Decoding is the concatenation of the
tokens' bytes.

Defined results: a null text is encoded like an empty one: no ids; a null id list decodes to
empty bytes; ids outside the vocabulary raise an error; repeated rows and null doc_ids each
return a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.llm.common import ship

CACHE_ENTRIES = 300_000  # a generation; two are held, some 60 MB each
CACHE_CHARS = 64         # longer pre-tokens are not remembered
_NEAR = 0x250
_FAR = re.compile("[^\x00-\u024f]").search


def _pieces(pattern: str):
    """(findall for any text, findall for texts below U+0250 or None). The second is the same
    pattern with its classes written out for that range, for the quicker standard engine."""
    import regex
    letters, numbers = ("".join(chr(c) for c in range(_NEAR) if unicodedata.category(chr(c))[0] == k) for k in "LN")
    space = "".join(chr(c) for c in range(_NEAR) if regex.match(r"\s", chr(c)))
    l, n, w = (re.escape(x) for x in (letters, numbers, space))
    near = (pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{w}{l}{n}]").replace(r"\p{L}", f"[{l}]").replace(r"\p{N}", f"[{n}]")
            .replace(r"\s", f"[{w}]").replace(r"\S", f"[^{w}]"))
    return regex.compile(pattern).findall, None if r"\p" in near else re.compile(near).findall


class _Memo(dict):
    """Ids, as text, of pre-tokens; what it lacks is looked up in the older generation or merged."""

    __slots__ = ("codec",)

    def __missing__(self, piece: str) -> str:
        got = self.codec.old.get(piece)
        if got is None:
            got = ",".join(map(str, self.codec.merge(piece.encode())))
        if len(piece) <= CACHE_CHARS:
            self[piece] = got
        return got


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_entries: int = CACHE_ENTRIES):
        self.cache_entries = cache_entries
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.text_of = {str(r): t for t, r in ranks.items()}
        self.single = [ranks[bytes((x,))] for x in range(256)]
        self.pair = [ranks.get(bytes((x, y)), -1) for x in range(256) for y in range(256)]
        self.split_any, self.split_near = _pieces(pattern)
        self.old: dict[str, str] = {}
        self._begin()

    def _begin(self) -> None:
        self.young = _Memo()
        self.young.codec = self

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        # symbol i spans piece[i:end[i]] and is the token tok[i]; made[i] is the rank under which
        # its pair with the next symbol is filed
        n = len(piece)
        pair, single = self.pair, self.single
        if n == 2:
            return [single[piece[0]], single[piece[1]]]
        tok = [single[x] for x in piece]
        made = [pair[x << 8 | y] for x, y in zip(piece, piece[1:])]
        made.append(-1)
        end = list(range(1, n + 1))
        before = list(range(-1, n))
        buckets: dict[int, list[int]] = {}  # rank -> heap of left positions
        words: dict[int, int] = {}          # rank >> 8 -> bits of its ranks with positions
        top = 0                             # bits of the words that are not zero
        i = 0
        for r in made:
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    hi = r >> 8
                    words[hi] = words.get(hi, 0) | 1 << (r & 255)
                    top |= 1 << hi
            i += 1
        while top:
            hi = (top & -top).bit_length() - 1  # find first set, word by word
            w = words[hi]
            low = w & -w
            rank = hi << 8 | low.bit_length() - 1
            held = buckets[rank]
            if len(held) > 1:
                i = heappop(held)
            else:
                i = held[0]
                del buckets[rank]
                w ^= low
                words[hi] = w
                if not w:
                    top ^= 1 << hi
            if made[i] != rank:
                continue  # stale: one of the two symbols has grown or gone
            j = end[i]
            stop = end[j]
            end[i] = stop
            tok[i] = rank
            made[j] = -1
            before[stop] = i
            r = get(piece[i:end[stop]]) if stop < n else None
            p = i
            while True:  # file the pair to the right, then the pair to the left
                if r is None:
                    made[p] = -1
                else:
                    made[p] = r
                    if r in buckets:
                        heappush(buckets[r], p)
                    else:
                        buckets[r] = [p]
                        hi = r >> 8
                        words[hi] = words.get(hi, 0) | 1 << (r & 255)
                        top |= 1 << hi
                if p != i or before[i] < 0:
                    break
                p = before[i]
                r = get(piece[p:stop])
        out, i = [], 0
        while i < n:
            out.append(tok[i])
            i = end[i]
        return out

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if len(self.young) >= self.cache_entries:
            self.old = self.young
            self._begin()
        split = self.split_any if self.split_near is None or _FAR(text) else self.split_near
        return ",".join(map(self.young.__getitem__, split(text)))

    def encode(self, text: str) -> list[int]:
        ids = self.encode_text(text)
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str, cache_entries: int = CACHE_ENTRIES) -> Codec:
    """The codec of a rank file and size of cache, one a process."""
    key = (path, pattern, cache_entries)
    if key not in _CODECS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        _CODECS[key] = Codec(ranks, pattern, cache_entries)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids array<int>)."""
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.bpe import codec
        c = codec(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [c.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, bytes binary) of rows (doc_id, ids)."""
    ship(encoded.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.bpe import codec
        c = codec(path, pattern)
        for b in batches:
            out = [c.decode(ids or ()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def encoded(docs: DataFrame, path: str, pattern: str, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Rows (doc_id, n_tokens, ids array<int>, ids_sha256, decoded_sha256). ``cache_entries`` trades a
    worker's memory for time; the rows are the same."""
    return _run(docs, path, pattern, True, cache_entries)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256. One pass: the ids of a
    text are decoded where they were made, only digests leave the task."""
    return _run(docs, path, pattern, False)


def _run(docs: DataFrame, path: str, pattern: str, with_ids: bool, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256
        import numpy as np
        import pyarrow as pa
        from kohort.llm.bpe import codec
        c = codec(path, pattern, cache_entries)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n, made, back, all_ids = [], [], [], []
                for t in part.column(1).to_pylist():
                    ids = c.encode_text(t or "")
                    parts = ids.split(",") if ids else []
                    n.append(len(parts))
                    made.append(sha256(ids.encode()).hexdigest())
                    back.append(sha256(b"".join([c.text_of[x] for x in parts])).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(parts, np.int32) if parts else np.zeros(0, np.int32))
                cols = {"doc_id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(made, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids)))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids))
