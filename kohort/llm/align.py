"""Cross-tokenizer alignment by lockstep merging.

Two tokenizers cut the same bytes (a space and the text) at different places. A link is a pair
of an A token and a B token whose byte ranges overlap; where tokens of both end, the text is
cut into groups.

1. Documents are taken in blocks of some 1 MB. A NumPy state vector holds a pair of pointers, to
   an A and a B token, for every document of the block. Each step emits the links of all
   pointer pairs, compares the ends, emits a cut where they agree, and advances the pointer of
   the earlier end (both at a cut). Finished documents are compacted away. A long document
   enters as several lanes, divided where tokens of both end, so the vector stays wide.
2. A block is one row: its distinct id pairs with the number of its documents that hold them
   linked, and, packed, what is known of each document (its pairs by place in that list). The
   blocks are materialised, for tokenizing costs most; texts are tokenized once.
3. The pair counts are summed over the blocks, the highest per A id is joined, and each block
   gets the counts of its own pairs back, one row a block and pair: nothing is broadcast, and
   neither a frequent pair nor copies of a document make a large group.
4. The documents' sums follow from their block's row alone.

A's ids are those of its byte-level BPE file as the ``tokenizers`` library has them. Where the
file's merges are ranked by id, ``tiktoken`` computes the same ids from the file's entries, at a
quarter of the time; texts with very long runs of white space, which its pattern engine refuses,
and other files go to ``tokenizers``.

Defined results: null and empty texts, and texts whose joined A or B bytes differ from space +
text (such as texts holding U+2581), have no tokens: zeros and an empty digest; strings of
special tokens are plain text; repeated rows and null doc_ids are documents of their own;
pairs tied for an A id's highest count all count as best; an empty table gives an empty result;
other columns are not read. A block is never smaller than a document, so memory follows the
longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.llm.common import cut, ship, slices

BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4096
LANE = 2048  # tokens of A after which a long document's next lane begins
_RUN = re.compile(r"\s{2000}")


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        import json
        import os
        import sentencepiece
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.path_a, self.slow = path_a, None
        of = _byte_of()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.n_a = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.bytes_a: list = [None] * self.n_a
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(of[c] for c in t)
        self.fast = _ranked(spec, self.bytes_a, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes((int(p[3:5], 16),)) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(x or b"") for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])

    def ids_a(self, text: str) -> list[int]:
        """A's ids of space + text."""
        if self.fast is not None and not _RUN.search(text):
            return self.fast.encode_ordinary(" " + text)
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path_a)
            self.slow.encode_special_tokens = True
        return self.slow.encode(" " + text, add_special_tokens=False).ids

    def ids(self, texts: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per text, the ids of A and of B; both empty where either does not give back space + text."""
        a, b = [], []
        for t in texts:  # one at a time: lists of Python's integers are large
            x, y = (self.ids_a(t), self.b.encode(t)) if t else ([], [])
            want = b" " + (t or "").encode()
            same = b"".join([self.bytes_a[i] or b"\0" for i in x]) == want and b"".join([self.bytes_b[i] for i in y]) == want
            a.append(np.array(x if same else [], np.int32))
            b.append(np.array(y if same else [], np.int32))
        return a, b


def _byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the other bytes, in order, for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(spec: dict, token_bytes: list, pattern: str):
    """The vocabulary as ranks for tiktoken, if it means the same: plain byte-level BPE whose merges make
    the ids in their order; else None."""
    pre = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    known = {t: i for i, t in enumerate(token_bytes) if t is not None}
    if not plain or made != sorted(set(made)) or len(made) + 256 != len(known) or min(made, default=256) < 256:
        return None
    import tiktoken
    return tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=known, special_tokens={})


_LOADED: dict[tuple, Tokenizers] = {}


def tokenizers(path_a: str, path_b: str, pattern: str) -> Tokenizers:
    """The tokenizers of these files, one a process."""
    key = (path_a, path_b, pattern)
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(*key)
    return _LOADED[key]


def lanes(end_a, end_b, first_a, first_b, most: int = LANE):
    """(a, a_stop, b, b_stop) of the lanes: documents, long ones divided at ends of both, about every
    ``most`` tokens of A. first_a and first_b bound the documents' tokens in the end arrays."""
    out = []
    for a, a1, b, b1 in zip(first_a[:-1].tolist(), first_a[1:].tolist(), first_b[:-1].tolist(), first_b[1:].tolist()):
        while a1 - a > most + 64:
            at = a + most
            ends = end_a[at:at + 64]
            k = np.searchsorted(end_b[b:b1], ends)
            hit = np.flatnonzero(end_b[b + k] == ends)
            if not len(hit):
                break  # the rest stays one lane
            m = int(hit[0])
            stop_a, stop_b = at + m + 1, b + int(k[m]) + 1
            out.append((a, stop_a, b, stop_b))
            a, b = stop_a, stop_b
        if a < a1:
            out.append((a, a1, b, b1))
    return np.array(out, np.int64).reshape(-1, 4).T


def lockstep(end_a, end_b, lane):
    """Links (i, j) of all lanes, step by step, and for each token of A and B whether it ends a group."""
    i, a_stop, j, _ = (x.copy() for x in lane)
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    link_a, link_b = np.empty(len(end_a) + len(end_b), np.int32), np.empty(len(end_a) + len(end_b), np.int32)
    n = 0
    while len(i):
        m = n + len(i)
        link_a[n:m], link_b[n:m] = i, j
        n = m
        ea, eb = end_a[i], end_b[j]
        both = ea == eb
        cut_a[i[both]] = True
        cut_b[j[both]] = True
        i += ea <= eb
        j += eb <= ea
        going = i < a_stop  # a lane's last tokens end together
        if not going.all():
            i, j, a_stop = i[going], j[going], a_stop[going]
    return link_a[:n], link_b[:n], cut_a, cut_b


class Aligned:
    """The alignment of some documents: token ids, ends, links and cuts, flat over all of them."""

    def __init__(self, tok: Tokenizers, texts: list):
        ids_a, ids_b = tok.ids(texts)
        self.first_a, self.first_b = (np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int32), *ids]) for ids in (ids_a, ids_b))
        self.end_a, self.end_b = (_ends(size[x], first) for size, x, first in ((tok.size_a, self.a, self.first_a), (tok.size_b, self.b, self.first_b)))
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(self.end_a, self.end_b, lanes(self.end_a, self.end_b, self.first_a, self.first_b))
        self.doc_of_a = np.repeat(np.arange(len(texts)), np.diff(self.first_a))
        self.link_doc = self.doc_of_a[self.link_a]

    def group_texts(self) -> list[bytes]:
        """Per document its groups as ``a1,a2|b1;a3|b2,b3``."""
        if not len(self.a):
            return [b""] * (len(self.first_a) - 1)
        stop_a, stop_b = np.flatnonzero(self.cut_a) + 1, np.flatnonzero(self.cut_b) + 1
        group_a, group_b = (np.cumsum(c) - c for c in (self.cut_a, self.cut_b))
        # A's tokens of a group come before B's
        place_a = np.arange(len(self.a)) + np.concatenate(([0], stop_b))[group_a]
        place_b = np.arange(len(self.b)) + stop_a[group_b]
        ids, sep = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        sep[place_a] = np.where(self.cut_a, ord("|"), ord(","))
        sep[place_b] = np.where(self.cut_b, ord(";"), ord(","))
        first = self.first_a + self.first_b
        sep[first[1:][np.diff(first) > 0] - 1] = 0  # nothing after a document's last id
        table = np.array([str(x).encode() for x in range(int(ids.max()) + 1)])
        width = table.itemsize
        size = np.char.str_len(table)[ids]
        text = np.zeros((len(ids), width + 1), np.uint8)
        text[:, :width] = table.view(np.uint8).reshape(-1, width)[ids]
        text[np.arange(len(ids)), size] = sep
        flat = text[text != 0].tobytes()
        at = np.concatenate(([0], np.cumsum(size + (sep != 0))))[first].tolist()
        return [flat[x:y] for x, y in zip(at, at[1:])]


def _ends(sizes, first):
    """Byte offsets, from the start of each document, where its tokens end."""
    total = np.cumsum(sizes)
    before = np.concatenate(([0], total))[first[:-1]]
    return total - np.repeat(before, np.diff(first))


def _parts(batches: Iterator, most_bytes: int, most_docs: int) -> Iterator:
    """(ids, texts) of consecutive rows, up to the given bytes or rows."""
    ids, texts, size = [], [], 0
    for b in (part for batch in batches for part in slices(batch)):
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= most_bytes or len(ids) >= most_docs:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _asked(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def alignments(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """Rows (doc_id, a_ids, b_ids, links array<struct<a, b>> of token places, cuts: byte offsets where groups end)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm import align
        tok = align.tokenizers(path_a, path_b, pattern)
        for ids, texts in align._parts(batches, align.BLOCK_BYTES, 256):
            got = align.Aligned(tok, texts)
            order = np.lexsort((got.link_b, got.link_a))
            doc = got.link_doc[order]
            links = pa.StructArray.from_arrays([pa.array(got.link_a[order] - got.first_a[doc], pa.int32()), pa.array(got.link_b[order] - got.first_b[doc], pa.int32())], names=["a", "b"])
            bounds = [got.first_a, got.first_b, np.searchsorted(doc, np.arange(len(ids) + 1)), np.concatenate(([0], np.cumsum(got.cut_a)))[got.first_a]]
            flat = [pa.array(got.a, pa.int32()), pa.array(got.b, pa.int32()), links, pa.array(got.end_a[got.cut_a], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), x) for n, x in zip(bounds, flat))],
                                             names=["doc_id", "a_ids", "b_ids", "links", "cuts"])

    return _asked(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>, cuts array<long>")


def blocks(docs: DataFrame, path_a: str, path_b: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, pairs, docs, body): a block's distinct id pairs (a * B's vocabulary + b), the number of its
    documents that hold each linked, and its documents as a packed Arrow table."""
    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256
        import pyarrow as pa
        from pyspark import TaskContext
        from kohort.llm import align
        tok = align.tokenizers(path_a, path_b, pattern)
        base = TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(align._parts(batches, block_bytes, align.BLOCK_DOCS)):
            got = align.Aligned(tok, texts)
            n = len(ids)
            cells = tok.n_a * tok.n_b
            key, times = np.unique(got.link_doc * cells + got.a[got.link_a].astype(np.int64) * tok.n_b + got.b[got.link_b], return_counts=True)
            pairs, at = np.unique(key % cells, return_inverse=True)
            first = pa.array(np.searchsorted(key, np.arange(n + 1) * cells).astype(np.int32))
            sha = [sha256(t).hexdigest() if t else "" for t in got.group_texts()]
            table = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (
                    np.diff(got.first_a), np.diff(got.first_b), np.bincount(got.doc_of_a[got.cut_a], minlength=n), np.bincount(got.link_doc, minlength=n))),
                 pa.array(sha, pa.string()), pa.ListArray.from_arrays(first, pa.array(at, pa.int32())), pa.ListArray.from_arrays(first, pa.array(times, pa.int32()))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(table)
            yield pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([pairs], pa.list_(pa.int64())),
                                              pa.array([np.bincount(at, minlength=len(pairs))], pa.list_(pa.int64())), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             names=["block", "pairs", "docs", "body"])

    return cut(_asked(docs).mapInArrow(run, "block long, pairs array<long>, docs array<long>, body binary"))


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): documents that hold the pair linked; whether no pair of its A id has more."""
    rows = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = rows.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"pair div {n_b}"))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def digest(docs: DataFrame, path_a: str, path_b: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The contract's columns: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    held = blocks(docs, path_a, path_b, pattern, block_bytes)
    rated = pair_counts(held, n_b)
    back = (held.select("block", F.explode("pairs").alias("pair")).join(rated, "pair")
            .groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("rated")))  # a block's own pairs, bounded by its size

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for k in range(b.num_rows):
                part = b.slice(k, 1)
                (table,) = pa.ipc.open_stream(part.column(0)[0].as_py())
                rated = part.column(1).flatten()
                order = np.argsort(rated.field("pair").to_numpy())
                count, best = (rated.field(c).to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("count", "best"))
                at, times = (table.column(c).flatten().to_numpy().astype(np.int64) for c in ("at", "times"))
                bounds = np.concatenate(([0], np.cumsum(table.column("at").value_lengths().to_numpy())))
                sums = [np.diff(np.concatenate(([0], np.cumsum(times * x[at])))[bounds]) for x in (best, count)]
                yield pa.RecordBatch.from_arrays([*table.columns[:5], *(pa.array(x, pa.int64()) for x in sums), table.column("groups_sha256")],
                                                 names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return (held.select("block", "body").join(back.hint("merge"), "block", "left").select("body", "rated")
            .mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
