"""Words of many texts at once, as numpy arrays over their concatenated UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 18  # bytes handled at once; longer texts are cut at white space
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list = []


def _powers():
    if not _POW:
        n = 2 * SEGMENT + 2
        with np.errstate(over="ignore"):
            for b in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                _POW.append(np.cumprod(p, dtype=np.uint64))
    return _POW


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: letters, digits and all bytes of non-ASCII characters
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text index of each segment, start of each segment); segments end in a line feed.

    Every text lies in one segment, or, if longer than SEGMENT, in several that are cut at
    white space (inside a word only if that word alone is longer). Texts keep their order.
    """
    held, owner, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = len(t)
            if end - at > SEGMENT:
                end = at + SEGMENT
                cut = max(t.rfind(b" ", at, end), t.rfind(b"\n", at, end))
                end = cut if cut > at else end
            if held and size + end - at > SEGMENT:
                yield _joined(held, owner)
                held, owner, size = [], [], 0
            held.append(t[at:end])
            owner.append(i)
            size += end - at + 1
            at = end
            if at >= len(t):
                break
    if held:
        yield _joined(held, owner)


def _joined(held, owner):
    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in held])[:-1])).astype(np.int64)
    return np.frombuffer(b"\n".join(held) + b"\n", np.uint8), np.array(owner, np.int64), starts


def spans(data: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = word_bytes[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Hasher:
    """64-bit hashes of byte spans of one segment array, all spans at once."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers()
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], dtype=np.uint64)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(32))
