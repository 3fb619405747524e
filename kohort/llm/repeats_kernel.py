"""Kernels of the repeat search: anchored blocks of a text, and the enhanced suffix array of blocks."""

from __future__ import annotations

import numpy as np

from kohort.llm.words import SEGMENT, Hasher

ANCHOR = 32  # bytes of an anchor


def blocks(texts: list[bytes], length: int):
    """The anchored blocks of many texts: arrays text, start, windows, the anchor's distance from
    the start, anchor hash, content hash.

    The anchor of a window of ``length`` bytes is the ANCHOR-byte string in it with the smallest
    hash, the leftmost if several; equal windows have equal anchors at equal offsets. A block is
    a run of windows with one anchor occurrence: windows start .. start + windows - 1. Every
    window of every text is in exactly one block. Windows of long texts are taken in parts."""
    out = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2]
    held, owner, at, size = [], [], [], 0

    def flush():
        if held:
            out.append(_blocks(held, np.array(owner), np.array(at), length))
        held.clear(), owner.clear(), at.clear()

    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - length + 1, 0), SEGMENT):
            part = t[a:a + SEGMENT + length - 1]
            if size + len(part) > SEGMENT:
                flush()
                size = 0
            held.append(part)
            owner.append(i)
            at.append(a)
            size += len(part)
    flush()
    return [np.concatenate(c) for c in zip(*out)]


def _blocks(parts, owner, at, length):
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    n = len(data) - ANCHOR + 1
    h = Hasher(data)
    grams = h(np.arange(n), np.arange(ANCHOR, n + ANCHOR))
    order = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    width, reach = length - ANCHOR + 1, 1
    while 2 * reach <= width:
        order = np.minimum(order[:-reach], order[reach:])
        reach *= 2
    if reach < width:
        order = np.minimum(order[:len(order) - (width - reach)], order[width - reach:])
    anchor = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window at each place
    # windows that lie in one part, and where their anchor changes
    inside = np.zeros(len(anchor) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.subtract.at(inside, np.minimum(begin + sizes - length + 1, len(anchor)), 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    fresh = inside.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    fresh[begin[begin < len(fresh)]] = True
    first = np.flatnonzero(fresh)
    last = np.flatnonzero(inside & ~np.append(inside[1:] & ~fresh[1:], False))
    part = np.searchsorted(begin, first, "right") - 1
    return [owner[part], at[part] + first - begin[part], last - first + 1, anchor[first] - first, grams[anchor[first]], h(first, last + length)]


class EnhancedSuffixArray:
    """Suffix array and LCPs of the windows of some blocks, to the end of each block.

    Only the places where a window starts are sorted. Blocks that hold equal windows must be
    sorted together; other blocks may be sorted with them, their windows share no
    ``length`` bytes."""

    def __init__(self, texts: list[bytes], windows: np.ndarray, length: int):
        width = max(map(len, texts))
        width += -width % 8
        self.length = length
        self.pitch = max(map(len, texts)) + width  # blocks are padded, so a suffix ends in zeros
        data = np.zeros((len(texts), self.pitch), np.uint8)
        for i, t in enumerate(texts):
            data[i, :len(t)] = np.frombuffer(t, np.uint8)
        sizes = np.array([len(t) for t in texts])
        self.block = np.repeat(np.arange(len(texts)), windows)
        self.offset = np.arange(len(self.block)) - np.repeat(np.cumsum(windows) - windows, windows)
        flat = data.ravel()
        place = self.block * self.pitch + self.offset
        suffixes = np.lib.stride_tricks.sliding_window_view(flat, width)[place]
        self.order = np.argsort(suffixes.view(f"S{width}").ravel(), kind="stable")
        rest = (sizes[self.block] - self.offset)[self.order]
        words = suffixes[self.order].view(np.uint64)
        diff = words[1:] ^ words[:-1]
        some = diff != 0
        first = some.argmax(axis=1)
        word = diff[np.arange(len(diff)), first]
        low = np.where(word == 0, 1, word & (~word + np.uint64(1))).astype(np.float64)
        lcp = np.where(some.any(axis=1), first * 8 + (np.log2(low).astype(np.int64) >> 3), width)
        #: lcp[r] of the suffixes r - 1 and r; lcp[0] = 0
        self.lcp = np.concatenate(([0], np.minimum(lcp, np.minimum(rest[1:], rest[:-1])))).astype(np.int64)
        # the byte to the left; the first window of a block counts as different from all
        left = np.where(self.offset > 0, flat[place - 1].astype(np.int64), 256 + np.arange(len(place)))[self.order]
        self.left_changes = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))

    def intervals(self):
        """All LCP intervals of at least ``length``, by one stack scan: (lcp, first rank, last rank)."""
        lcp, length = self.lcp, self.length
        deep = lcp >= length
        edge = np.diff(np.concatenate(([0], deep.astype(np.int8), [0])))
        out = []
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if e == s + 1:
                out.append((int(lcp[s]), s - 1, s))
                continue
            stack: list[tuple[int, int]] = []
            r = s
            for h in lcp[s:e].tolist() + [0]:
                first = r - 1
                while stack and stack[-1][0] > h:
                    top, first = stack.pop()
                    out.append((top, first, r - 1))
                if h and (not stack or stack[-1][0] < h):
                    stack.append((h, first))
                r += 1
        return np.array(out, np.int64).reshape(-1, 3)

    def maximal_repeats(self):
        """The intervals whose occurrences are not all preceded by the same byte: (length, first
        rank, last rank); the occurrences are the suffixes of those ranks."""
        found = self.intervals()
        diverse = self.left_changes[found[:, 2]] > self.left_changes[found[:, 1]]
        return found[diverse]

    def covered(self):
        """Bytes of the blocks that occurrences of maximal repeats cover: (block, first, end) of the runs."""
        groups = self.maximal_repeats()
        longest = np.zeros(len(self.order), np.int64)
        for size, a, b in groups[np.argsort(groups[:, 0], kind="stable")].tolist():
            longest[a:b + 1] = size  # a longer repeat lies inside a shorter one's ranks
        hit = np.flatnonzero(longest)
        place = self.block[self.order[hit]] * self.pitch + self.offset[self.order[hit]]
        edge = np.zeros(int(self.block[-1] + 1) * self.pitch + 1, np.int32) if len(self.block) else np.zeros(1, np.int32)
        np.add.at(edge, place, 1)
        np.subtract.at(edge, place + longest[hit], 1)
        step = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8))))
        first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return first // self.pitch, first % self.pitch, end - first // self.pitch * self.pitch


def merged(first: np.ndarray, end: np.ndarray):
    """The union of ranges as sorted, separate ranges."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    return first[new], end[np.append(np.flatnonzero(new)[1:], len(first)) - 1] if len(first) else end
