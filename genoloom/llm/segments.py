"""Segments: runs of neighbouring windows with one key, whose contents meet in the bucket that owns the key and are compared there.

A window's key (the least hash of its grams, its minimizer) depends on its content alone, so equal windows have equal keys
and meet in one bucket. A unit sends each distinct content of a segment once, with a weight of 2 if it has it several times; the bucket
keeps each distinct content once, and of each message only which contents it holds. What it compares are the contents themselves.

A passage that a third of all documents share stands in ever new surroundings, so its key has ever new contents. Such a hot key
(units.HOT) is refined by further minimizers, by other hashes of the same grams: windows that reach out of the passage part ways
and go to buckets all over, and windows that don't are the same few everywhere.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np

from .units import Answer, Replies, mix, sliding

# What further hashes of a gram are salted with.
SALTS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xA0761D6478BD642F)


def refined(grams: np.ndarray, width: int, first: np.ndarray, count: np.ndarray, keys: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments (first window, number of windows, key) with the hot ones cut further, by keys of several minimizers.

    grams: hashes by position; a window holds `width` of them.
    """
    if not hot.any():
        return first, count, keys
    start, n = first[hot], count[hot]
    places = n + width - 1
    which = np.repeat(np.arange(len(n)), places)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(places) - places, places)
    held = grams[start[which] + inside]
    window = np.flatnonzero(inside < n[which])
    key = keys[hot][which[window]]
    for salt in SALTS:
        key = mix(key + sliding(mix(held ^ np.uint64(salt)), width, np.minimum)[window])
    opens = np.append(True, (key[1:] != key[:-1]) | (which[window[1:]] != which[window[:-1]]))
    at = np.flatnonzero(opens)
    new_first = (start[which] + inside)[window[at]]
    cold = ~hot
    return np.append(first[cold], new_first), np.append(count[cold], np.diff(np.append(at, len(window)))), np.append(keys[cold], key[at])


class Sent:
    """Distinct contents of a unit's segments, in the order in which each bucket gets them."""

    def __init__(self, contents: list[bytes], keys: np.ndarray, windows: np.ndarray, buckets: int):
        """Of each segment its content, key and number of windows."""
        numbers: dict[bytes, int] = {}
        kind = np.fromiter((numbers.setdefault(c, len(numbers)) for c in contents), np.int64, len(contents))
        first = np.unique(kind, return_index=True)[1]
        bucket = ((keys[first] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        held = list(numbers)
        self.windows, self.kind = windows, place[kind]  # of every segment, its place among the distinct ones
        self.contents = [held[i] for i in order.tolist()]
        self.kind_bucket, self.kind_windows = bucket[order], windows[first][order]
        self.weight = np.minimum(np.bincount(kind, minlength=len(first)), 2)[order] if len(first) else np.zeros(0, np.int64)

    def cuts(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, first, end) among the distinct contents."""
        edges = [0, *(np.flatnonzero(np.diff(self.kind_bucket)) + 1).tolist(), len(self.kind_bucket)]
        for s, e in zip(edges, edges[1:], strict=False):
            if e > s:
                yield int(self.kind_bucket[s]), s, e

    def messages(self) -> Iterator[tuple[int, bytes]]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for bucket, s, e in self.cuts():
            sizes = np.array([len(c) for c in self.contents[s:e]], "<u4")
            yield bucket, struct.pack("<I", e - s) + sizes.tobytes() + self.weight[s:e].astype(np.uint8).tobytes() + pack(b"".join(self.contents[s:e]))

    def repeated(self, replies: Replies) -> tuple[np.ndarray, np.ndarray]:
        """(segment, window in it) of all windows that occur again."""
        bits = [np.unpackbits(np.frombuffer(replies[b], np.uint8), count=int(self.kind_windows[s:e].sum())) for b, s, e in self.cuts()]
        again = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
        base = np.cumsum(self.kind_windows) - self.kind_windows  # where a distinct content's windows stand in again
        n = self.windows
        run = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        hit = again[base[self.kind[run]] + inside]
        return run[hit], inside[hit]


def compared(repeated: Callable[[list[bytes], list[int]], list[np.ndarray]]) -> Answer:
    """Answers each message of contents with a bit for each of their windows, all contents after one another.

    repeated(contents, weights): for each distinct content, which of its windows occur again in all of them.
    """

    def answer(messages: Iterator[bytes]) -> Iterator[bytes]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        texts: dict[bytes, int] = {}
        weights, held, counts = array("q"), array("i"), array("i")
        for m in messages:
            (n,) = struct.unpack_from("<I", m)
            sizes, own = np.frombuffer(m, "<u4", n, 4).tolist(), np.frombuffer(m, np.uint8, n, 4 + 4 * n).tolist()
            body, at = unpack(m[4 + 5 * n :]), 0
            for size, w in zip(sizes, own, strict=True):
                k = texts.setdefault(body[at : at + size], len(texts))
                if k == len(weights):
                    weights.append(0)
                weights[k] += w
                held.append(k)
                at += size
            counts.append(n)
        found = repeated(list(texts), weights.tolist())
        at = 0
        for n in counts:
            yield np.packbits(np.concatenate([found[k] for k in held[at : at + n]])).tobytes()
            at += n

    return answer
