"""Substring dedup over words: difference-cover anchors find candidate windows, and whole windows confirm them.

A difference cover D modulo v has, for any two positions i and j, a shift l < v with i + l and j + l both in D. Grams of
window - v + 1 words are hashed only at positions in D (counted in their document). Two equal windows, wherever they
start, then share an anchor gram at the same place in both; every window around a shared anchor is a candidate. Matches are
extended from there to whole windows by the words themselves: runs of one, two, four ... words get numbers that are
equal for equal runs only. Hashes find anchors and the bucket where candidates meet, and decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scan_partitions, table
from .segments import Sent, compared, refined
from .units import UNITS_PER_BUCKET, Replies, Rolling, Shared, Unit, ask, each_unit, in_several, make_units, mix, sliding, told

WINDOW = 35
#: Words of the grams whose least hash is a window's key.
GRAM = 6

# Perfect difference sets by modulus.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest modulus that leaves anchors of two fifths of the window; modulus 1 (every position) for short windows."""
    fits = [v for v in COVERS if window - v + 1 >= 0.4 * window]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


class Words:
    """Words of a unit's documents: places in its bytes, the words joined by single spaces, and hashes."""

    def __init__(self, unit: Unit):
        b = unit.bytes
        self.unit, self.space = unit, (b == 32) | ((b >= 9) & (b <= 13))
        before = np.append(True, self.space[:-1])[: len(b)]
        self.starts, self.ends = np.flatnonzero(before & ~self.space), np.flatnonzero(~before & self.space)  # the last byte is a line feed
        self.first = np.searchsorted(self.starts, unit.starts)  # of each document
        self.last = np.append(self.first[1:], len(self.starts)) if len(self.first) else self.first
        held = ~self.space
        held[self.ends] = True  # and the space after each word
        self.joined = np.where(self.space, np.uint8(32), b)[held].tobytes()
        self.offset = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])  # of each word in joined
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(self.offset), pa.py_buffer(self.joined)])
        coded = words.dictionary_encode()
        known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
        self.hashes = known[coded.indices.to_numpy()] if len(words) else known
        doc = np.repeat(np.arange(len(self.first)), self.last - self.first)
        self.place = np.arange(len(self.starts)) - self.first[doc]  # in its document
        self.room = self.last[doc] - np.arange(len(self.starts))  # words from here to the document's end


class Candidates:
    """Anchors of a unit, and its windows as segments with one key (the least hash of their grams)."""

    def __init__(self, words: Words, window: int, buckets: int):
        v, cover = cover_for(window)
        self.words, self.window, self.buckets, self.reach = words, window, buckets, v - 1
        gram, small = window - v + 1, min(GRAM, window)
        is_cover = np.zeros(v, bool)
        is_cover[list(cover)] = True
        rolling = Rolling(words.hashes)
        self.at = np.flatnonzero(is_cover[words.place % v] & (words.room >= gram) & (words.place + words.room >= window))
        anchors = mix(rolling.of(self.at, self.at + gram))
        self.grams, self.width = mix(rolling.every(small)), window - small + 1
        whole = np.flatnonzero(words.room >= window)
        self.keys = sliding(self.grams, self.width, np.minimum)[whole] if len(whole) else np.zeros(0, np.uint64)
        self.whole = whole
        # anchors and keys travel together, told apart by a bit
        both = np.concatenate([anchors << np.uint64(1), np.unique(self.keys) << np.uint64(1) | np.uint64(1)])
        self.shared = Shared(both >> np.uint64(32), both.astype(np.uint32), buckets)

    def sent(self, replies: Replies) -> tuple[np.ndarray, Sent]:
        """Starts of the segments of windows that hold a shared anchor, and what of them is sent."""
        words, window, anchors = self.words, self.window, len(self.at)
        hit = self.at[self.shared.repeated(replies)[:anchors]]
        change = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(change, hit - np.minimum(self.reach, words.place[hit]), 1)
        np.add.at(change, hit + 1, -1)
        near = (np.cumsum(change[:-1]) > 0)[self.whole]
        starts, keys = self.whole[near], self.keys[near]
        if not len(starts):
            return starts, Sent([], keys, starts, self.buckets)
        opens = np.append(True, (starts[1:] != starts[:-1] + 1) | (keys[1:] != keys[:-1]) | (words.place[starts[1:]] == 0))
        first = np.flatnonzero(opens)
        hot = self.shared.hot(replies)[anchors:][np.searchsorted(np.unique(self.keys), keys[first])]
        at, count, keys = refined(self.grams, self.width, starts[first], np.diff(np.append(first, len(starts))), keys[first], hot)
        a, z = words.offset[at], words.offset[at + count + window - 1] - 1
        contents = [words.joined[s:e] for s, e in zip(a.tolist(), z.tolist(), strict=True)]
        return at, Sent(contents, keys, count, self.buckets)


def repeated_runs(texts: list[bytes], weights: list[int], window: int) -> list[np.ndarray]:
    """For each text, which of its windows of words (by start) occur again: in the others, in itself, or as it has a weight over 1.

    Words get numbers, and a run of 2 k words the number of its pair of runs of k words: equal runs alone have equal numbers.
    """
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    number = pa.array([w for t in words for w in t], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    ends, text = np.cumsum(sizes), np.repeat(np.arange(len(texts)), sizes)
    pairs = lambda a, b: np.unique(a * (int(number.max()) + 1) + b, return_inverse=True)[1]
    span = 1
    while 2 * span <= window:
        number = pairs(number[: len(number) - span], number[span:])
        span *= 2
    if span < window:
        number = pairs(number[: len(number) - (window - span)], number[window - span :])
    whole = np.arange(len(number)) + window <= ends[text[: len(number)]]  # else it reaches into the next text
    weight = np.where(whole, np.asarray(weights, np.int64)[text[: len(number)]], 0)
    again = (np.bincount(number, weights=weight)[number] > 1) & whole
    return [again[e - n : e - window + 1] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def dedup_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): docs without the words that a window repeated anywhere covers.

    Words are runs without ASCII white space, unchanged; kept joins what stays with one space. A window is repeated if the same
    words start anywhere else, in the same document or another; all windows are judged on the input. A null or
    empty text has no words. Repeated rows are documents of their own, null doc_ids too; other columns are ignored.
    """
    units = make_units(docs)
    count = max(1, units.count())
    buckets = max(1, -(-count // UNITS_PER_BUCKET))
    partitions = max(buckets, scan_partitions(units))

    def send_anchors(unit: Unit, _: list[Replies]) -> Iterator[tuple[int, bytes]]:
        return Candidates(Words(unit), window, buckets).shared.messages()

    def send_windows(unit: Unit, replies: list[Replies]) -> Iterator[tuple[int, bytes]]:
        return Candidates(Words(unit), window, buckets).sent(replies[0])[1].messages()

    def cut(unit: Unit, replies: list[Replies]) -> Iterator[pa.RecordBatch]:
        words = Words(unit)
        starts, sent = Candidates(words, window, buckets).sent(replies[0])
        segment, inside = sent.repeated(replies[1])
        hit = starts[segment] + inside
        change = np.zeros(len(words.starts) + 1, np.int64)
        change[hit] += 1  # starts are distinct
        change[hit + window] -= 1
        stays = np.cumsum(change[:-1]) == 0
        # a kept word keeps the byte after it, which becomes a space
        b = unit.bytes.copy()
        b[words.space] = 32
        change = np.zeros(len(b) + 2, np.int8)
        change[words.starts[stays]] += 1
        change[words.ends[stays] + 1] -= 1
        mask = np.cumsum(change[: len(b)], dtype=np.int8) > 0
        out, before = b[mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])
        texts = [out[s : max(s, e - 1)] for s, e in zip(before[unit.starts].tolist(), before[np.minimum(unit.ends + 1, len(b))].tolist(), strict=True)]
        kept = np.concatenate([[0], np.cumsum(stays)])
        n = words.last - words.first
        removed = n - (kept[words.last] - kept[words.first])
        columns = [pa.array(unit.doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    first = ask(told(units, []), send_anchors, in_several(np.uint32), partitions)
    second = ask(told(units, [first]), send_windows, compared(lambda texts, weights: repeated_runs(texts, weights, window)), partitions)
    return each_unit(told(units, [first, second]), cut, "doc_id long, n_words long, n_removed long, kept string").drop("unit")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, removed words and the rest."""
    found = dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    """The same rows by counting whole windows as strings; doc_ids are unique."""
    return f"""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
    windows as (select doc_id, i, array_to_string(ws[i : i + {WINDOW} - 1], ' ') as k from (select *, unnest(range(1, len(ws) - {WINDOW} + 2)) as i from w)),
    repeated as (select doc_id, i from windows where k in (select k from windows group by k having count(*) > 1)),
    gone as (select distinct doc_id, i + j as p from (select *, unnest(range(0, {WINDOW})) as j from repeated)),
    words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
    kept as (select words.doc_id, count(*) as n, string_agg(word, ' ' order by words.p) as t from words anti join gone on words.doc_id = gone.doc_id and words.p = gone.p group by words.doc_id)
    select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
    from w left join kept on w.doc_id = kept.doc_id"""
