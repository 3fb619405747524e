"""License scan with a generalised suffix automaton of licence words.

All templates (base phrases and licence notices, as word sequences) go into one suffix
automaton. A file's words are streamed through it; after each word it knows the longest run
of words ending there that occurs in any template (the matching statistics). From them:

* base places: a phrase ends where the current match is at least as long as the phrase and the
  phrase is a suffix of the automaton's state (marked along suffix links);
* spans: matches that cannot be extended and have at least ``MIN_MATCH`` words are chained, per
  template, in order of place and template offset with gaps of at most ``MAX_GAP`` words, so
  that most words are covered; a chain that covers at least ``MIN_COVER`` of its template is a
  span and gives its label.

The score is the largest share of a template (base phrases included) that a chain covers.
The automaton depends on the templates alone, so it is built once per worker; files are
scanned whole, one at a time, in one pass without a shuffle.

Defined results: null, blank and wordless texts have n_words 0, no places, empty labels and
score 0; repeated rows and null doc_ids each return a row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.llm.common import ship, slices, text_bytes

MIN_MATCH, MAX_GAP, MIN_COVER = 3, 8, 0.6

#: base phrases and their labels (fixed by the contract)
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: labels of the method's own: opening words of common notices
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution", "cc"),
    ("all rights reserved", "proprietary"),
)

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall  # non-ASCII characters are word characters


def words_of(text: bytes) -> list[bytes]:
    return _WORDS(text.lower())  # bytes: lower-cases A-Z only


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, base=BASE, templates=TEMPLATES):
        self.sequences = [words_of(t.encode()) for t, _ in (*base, *templates)]
        self.labels = [label for _, label in (*base, *templates)]
        self.n_base = len(base)
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        at: list[list[tuple[int, int]]] = [[]]  # (template, words up to and with the state's end)
        for t, seq in enumerate(self.sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                while len(at) < len(self.next):
                    at.append([])
                at[last].append((t, i + 1))
        # a state's places are those of all states whose suffix it is
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            at[self.link[s]].extend(at[s])
        self.places = [sorted(set(a)) for a in at]
        # phrases that are suffixes of a state, longest first along its links
        ends = {}
        for t in range(self.n_base):
            s = 0
            for w in self.sequences[t]:
                s = self.next[s][w]
            ends.setdefault(s, []).append(t)
        self.phrases: list[list[tuple[int, int]]] = []
        for s in range(len(self.next)):
            found, v = [], s
            while v > 0:
                found += [(len(self.sequences[t]), t) for t in ends.get(v, ())]
                v = self.link[v]
            self.phrases.append(found)

    def _new(self, length: int, link: int, go: dict) -> int:
        self.next.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """A copy of q for the strings that end p's by w."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:  # the sequence so far occurs in an earlier one
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        made, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return made

    def stream(self, words: list[bytes]):
        """(base places as (phrase, start); maximal matches as (end, length, state)).

        A match is kept where the next word cannot extend it and it has MIN_MATCH words, or is
        a base phrase as a whole."""
        go, link, length, phrases = self.next, self.link, self.length, self.phrases
        root = go[0]
        base, matches = [], []
        s = l = 0
        for i, w in enumerate(words):
            if not s and w not in root:
                continue
            t = go[s].get(w)
            if t is None:
                if l >= MIN_MATCH:
                    matches.append((i, l, s))
                while s and w not in go[s]:
                    s = link[s]
                t = go[s].get(w)
                if t is None:
                    s = l = 0
                    continue
                l = length[s]
            s, l = t, l + 1
            for n, p in phrases[s]:
                if n <= l:
                    base.append((p, i + 1 - n))
                    if l < MIN_MATCH:
                        matches.append((i + 1, l, s))
        if l >= MIN_MATCH:
            matches.append((len(words), l, s))
        return base, matches

    def chains(self, matches):
        """Best chains as (template, share covered, first word, end).

        A match is a fragment at each of its template places. Fragments of a template follow one
        another in ascending end and offset, a next one beginning at most MAX_GAP words behind
        the last; it adds the words that lie behind both the end and the offset reached. Every
        fragment takes the predecessor that covers most (then the later first word), so no stray
        match can break a chain. Matches come in ascending end and start, so a fragment that is
        too far behind stays so: those held reach back a template's length at most. Of the chains
        that share a first fragment the one that covers most is given."""
        held: dict[int, list] = {}  # template -> fragments still in reach: (end, offset, covered, first word, chain)
        best: list[tuple] = []      # by chain: (template, covered, first word, end)
        for end, l, s in matches:
            start = end - l
            for t, places in groupby(self.places[s], key=lambda at: at[0]):
                near = [f for f in held.get(t, ()) if start - f[0] <= MAX_GAP]
                made = []
                for _, offset in places:
                    covered, first, chain = max(((c + min(l, end - e, offset - o), a, k) for e, o, c, a, k in near if e < end and o < offset),
                                                default=(0, 0, 0))
                    if (l, start) >= (covered, first):
                        covered, first, chain = l, start, len(best)
                        best.append((t, 0, 0, 0))
                    if covered > best[chain][1]:
                        best[chain] = (t, covered, first, end)
                    made.append((end, offset, covered, first, chain))
                held[t] = near + made
        return [(t, covered / len(self.sequences[t]), first, end) for t, covered, first, end in best]

    def scan(self, text: bytes) -> dict:
        words = words_of(text)
        base, matches = self.stream(words)
        chains = self.chains(matches)
        spans = sorted({(self.labels[t], a, b) for t, share, a, b in chains if share >= MIN_COVER})
        known = {self.labels[p] for p, _ in base}
        return {"n_words": len(words), "n_base": len(base), "first_word": min((a for _, a in base), default=None),
                "last_word": max((a for _, a in base), default=None), "base_labels": ",".join(sorted(known)),
                "labels": ",".join(sorted(known | {x for x, _, _ in spans})),
                "score": float(min(1.0, max((share for _, share, _, _ in chains), default=0.0))),
                "spans": [{"label": x, "first": a, "end": b} for x, a, b in spans]}


_BUILT: list[Automaton] = []


def automaton() -> Automaton:
    """The automaton of the standard templates, one a process."""
    if not _BUILT:
        _BUILT.append(Automaton())
    return _BUILT[0]


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
    ship(docs.sparkSession)
    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    spans = "array<struct<label: string, first: long, end: long>>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.license_scan import automaton
        a = automaton()
        types = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                 ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])))]
        for b in (part for batch in batches for part in slices(batch)):
            got = [a.scan(t) for t in text_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([g[n] for g in got], t) for n, t in types], names=["doc_id"] + [n for n, _ in types])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, f"doc_id long, {fields}, spans {spans}"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the spans."""
    return scan(docs)
