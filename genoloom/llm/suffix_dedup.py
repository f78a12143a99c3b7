"""Suffix-array dedup: repeated byte strings found in suffix arrays that induced sorting builds, shard by shard.

Sharding: the least gram hash of a window (its minimizer) depends on the window's bytes alone, so equal windows
have equal keys. Neighbouring windows with one key are a segment; segments whose key occurs once anywhere can't hold a repeat
and are left out, the others go to the shard that owns the key, each distinct one once with its multiplicity.

Within a shard: suffixes are classified, leftmost-smaller (LMS) substrings sorted by induction and named, the string of
names is sorted, and the whole array induced from it. Induction runs bucket by bucket, each bucket's entries at once. The
names' suffixes are sorted by doubling ranks, not by induction again: an alphabet as large as its string has buckets
of one entry. Prefixes common with the neighbour in the array are computed in text order (permuted): irreducible ones by
comparison up to the window, the others carried from the position before. Equality is always that of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scan_partitions, table
from .segments import Sent, compared, refined
from .units import Replies, Rolling, Shared, Unit, ask, each_unit, in_several, make_units, mix, sliding, told

WINDOW = 200
#: Bytes of the grams whose least hash is a window's key.
GRAM = 24
#: Units for each shard: what one suffix array holds.
UNITS_PER_SHARD = 2


# ---- suffix arrays

def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor (S); the last, a unique least symbol, is S."""
    n = len(s)
    up = np.ones(n, bool)
    if n > 1:
        differs = np.append(s[1:] != s[:-1], True)
        decided = np.flatnonzero(differs)  # a run of equal symbols has the type of its last one
        last = decided[np.searchsorted(decided, np.arange(n))]
        up[:-1] = s[last[:-1]] < s[np.minimum(last[:-1] + 1, n - 1)]
        up[last == n - 1] = True
    return up


def _append(sa: np.ndarray, at: np.ndarray, s: np.ndarray, found: np.ndarray, step: int) -> None:
    """Puts found, in order, into the buckets of their symbols; at holds each bucket's next place."""
    symbols = s[found]
    order = np.argsort(symbols, kind="stable")
    ordered, symbols = found[order], symbols[order]
    first = np.concatenate([[True], symbols[1:] != symbols[:-1]])
    starts = np.flatnonzero(first)
    rank = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    sa[at[symbols] + step * rank] = ordered
    at[symbols[starts]] += step * np.diff(np.append(starts, len(symbols)))


def induce(s: np.ndarray, up: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that LMS suffixes in the given order induce, each bucket's entries in whole rounds."""
    n = len(s)
    counts = np.bincount(s, minlength=size)
    heads, tails = np.cumsum(counts) - counts, np.cumsum(counts) - 1
    sa = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    at = tails.copy()
    _append(sa, at, s, lms[::-1], -1)
    placed = tails - at  # LMS suffixes at each bucket's end
    used = np.flatnonzero(counts)

    at = heads.copy()
    for c in used.tolist():  # larger suffixes, left to right
        done, lms_from = heads[c], tails[c] - placed[c] + 1
        while done < at[c]:
            now = sa[done : at[c]]
            done = at[c]
            before = now[now > 0] - 1
            before = before[~up[before]]
            if len(before):
                _append(sa, at, s, before, 1)
        if placed[c]:
            now = sa[lms_from : tails[c] + 1]
            before = now[now > 0] - 1
            before = before[~up[before]]
            if len(before):
                _append(sa, at, s, before, 1)
    larger_to = at
    at = tails.copy()
    for c in used[::-1].tolist():  # smaller suffixes, right to left
        done = tails[c]
        while done > at[c]:
            now = sa[at[c] + 1 : done + 1][::-1]
            done = at[c]
            before = now[now > 0] - 1
            before = before[up[before]]
            if len(before):
                _append(sa, at, s, before, -1)
        now = sa[heads[c] : larger_to[c]][::-1]
        before = now[now > 0] - 1
        before = before[up[before]]
        if len(before):
            _append(sa, at, s, before, -1)
    sa[0] = n - 1  # the sentinel, which nothing induces
    return sa


def _names(s: np.ndarray, up: np.ndarray, is_lms: np.ndarray, sorted_lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring in sorted order, equal ones alike; ends: the last position of the one at a position."""
    a, b = sorted_lms[:-1], sorted_lms[1:]
    length = ends[a] - a
    same = length == ends[b] - b
    alive = np.flatnonzero(same)
    d = 0
    while len(alive):
        ok = s[a[alive] + d] == s[b[alive] + d]
        same[alive[~ok]] = False
        alive = alive[ok]
        alive = alive[length[alive] > d]
        d += 1
    return np.concatenate([[0], np.cumsum(~same)])


def _rank_suffixes(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of names, by doubling ranks; only suffixes whose rank is still shared are sorted again."""
    n, k = len(names), 1
    order = np.argsort(names, kind="stable")
    fresh = np.append(True, names[order[1:]] != names[order[:-1]])
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    open_at = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # places of suffixes whose rank is shared
    while len(open_at):
        members = order[open_at]
        own, ahead = rank[members], members + k
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = own * (n + 1) + following
        by = np.argsort(key)
        order[open_at], key = members[by], key[by]
        fresh = np.append(True, key[1:] != key[:-1])
        rank[order[open_at]] = open_at[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        open_at = open_at[~(fresh & np.append(fresh[1:], True))]
        k *= 2
    return order


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of s, integers of which the last is a unique least 0."""
    s = np.asarray(s)
    s = s.astype(np.int16 if s.max() < 1 << 15 else np.int64)  # short symbols are sorted by radix
    if len(s) == 1:
        return np.zeros(1, np.int64)
    up = suffix_types(s)
    is_lms = np.concatenate([[False], up[1:] & ~up[:-1]])
    lms = np.flatnonzero(is_lms)
    size = int(s.max()) + 1
    ends = np.zeros(len(s), np.int64)
    ends[lms] = np.append(lms[1:], len(s) - 1)
    approximate = induce(s, up, lms, size)
    sorted_lms = approximate[is_lms[approximate]]
    names = np.empty(len(s), np.int64)
    names[sorted_lms] = _names(s, up, is_lms, sorted_lms, ends)
    order = _rank_suffixes(names[lms])
    return induce(s, up, lms[order], size)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, the symbols (at most `most`) that its suffix shares with its predecessor in the array.

    Only irreducible values are compared: where the symbols before a suffix and before its predecessor are equal, those two
    suffixes are neighbours as well, so the value is one less than that of the position before, and is carried. Comparisons
    end after twice `most` symbols, and a value is carried over less than `most` positions.
    """
    n = len(s)
    before = np.empty(n, sa.dtype)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n - 1
    apart = np.ones(n, bool)  # irreducible
    apart[1:] = (before[1:] == 0) | (s[:-1] != s[before[1:] - 1])
    apart[sa[0]] = True
    place = np.arange(n)
    apart |= (place - np.maximum.accumulate(np.where(apart, place, 0))) % most == 0  # nothing is carried further than `most`
    # symbols have nine bits, seven of them a word; no two suffixes agree up to the unique last symbol
    padded = np.concatenate([s.astype(np.int64) + 1, np.zeros(7, np.int64)])
    word = padded[:n].copy()
    for k in range(1, 7):
        word = (word << 9) | padded[k : k + n]
    value, d = np.zeros(n, np.int32), 0
    alive = np.flatnonzero(apart & (np.arange(n) != sa[0]))
    while len(alive) and d < 2 * most:
        other = word[alive + d] ^ word[before[alive] + d]
        ended = other != 0
        differs, same = other[ended], np.full(int(ended.sum()), d, np.int32)
        for k in range(1, 7):
            same += (differs >> (9 * (7 - k))) == 0
        value[alive[ended]] = same
        alive = alive[~ended]
        d += 7
        value[alive] = d
    last = np.maximum.accumulate(np.where(apart, place, 0))
    return np.minimum(np.maximum(value[last] - (place - last), 0), most)


def repeated_starts(texts: list[bytes], weights: list[int], window: int) -> list[np.ndarray]:
    """For each text, which of its windows (by start) occur again: in the others, in itself, or as it has a weight over 1."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int16) + 2
    joined[starts + sizes] = 1  # parts texts
    s = np.append(joined, np.int16(0))
    sa = suffix_array(s)
    common = permuted_common_prefixes(s, sa, window)
    text = np.append(np.repeat(np.arange(len(texts)), sizes + 1), 0)
    room = np.append(np.repeat(starts + sizes, sizes + 1), 0) - np.arange(len(s))  # symbols to the text's end
    whole = (room >= window)[sa]
    joins = np.append(False, (common[sa[1:]] >= window) & whole[1:] & whole[:-1])
    group = np.cumsum(~joins) - 1
    weight = np.where(whole, np.asarray(weights, np.int64)[text[sa]], 0)
    again = np.empty(len(s), bool)
    again[sa] = (np.bincount(group, weights=weight)[group] > 1) & whole
    return [again[a : a + max(0, n - window + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


# ---- segments

class Segments:
    """Maximal runs of windows with one key in a unit's documents, as byte ranges."""

    def __init__(self, unit: Unit, window: int, gram: int):
        b = unit.bytes
        self.unit, n, width = unit, len(b) - window + 1, window - gram + 1
        self.grams = grams = mix(Rolling(b.astype(np.uint64) + np.uint64(1)).every(gram))
        if n <= 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.keys, self.inner = np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        keys = sliding(grams, width, np.minimum)
        valid = np.zeros(len(b) + 1, np.int32)
        fits = unit.ends - unit.starts >= window
        valid[unit.starts[fits]] += 1
        valid[unit.ends[fits] - window + 1] -= 1
        valid = np.cumsum(valid[:n]) > 0
        opens = valid.copy()
        opens[1:] &= ~valid[:-1] | (keys[1:] != keys[:-1])
        closes = valid.copy()
        closes[:-1] &= ~valid[1:] | (keys[1:] != keys[:-1])
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        self.starts, self.ends, self.keys = first, last + window, keys[first]
        # a key's gram twice in a segment: windows may repeat inside it
        wide = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, keys, np.uint64(0)), np.zeros(width - 1, np.uint64)])
        least = np.flatnonzero(sliding(wide, width, np.maximum) == grams[: n + width - 1])
        twice = np.concatenate([[0], np.cumsum(grams[least[1:]] == grams[least[:-1]])]) if len(least) else np.zeros(1, np.int64)
        a = np.minimum(np.searchsorted(least, first), len(least) - 1)
        z = np.searchsorted(least, last + width, "left") - 1
        self.inner = twice[np.maximum(z, a)] > twice[a]

    def candidates(self, buckets: int) -> Shared:
        return Shared(self.keys >> np.uint64(32), self.keys.astype(np.uint32), buckets)


def _sent(unit: Unit, replies: Replies, window: int, gram: int, buckets: int) -> tuple[np.ndarray, Sent]:
    """Starts of the segments that may hold repeats, and what of them is sent."""
    segments = Segments(unit, window, gram)
    shared = segments.candidates(buckets)
    pick = np.flatnonzero(shared.repeated(replies) | segments.inner)
    starts, count, data = segments.starts[pick], (segments.ends - segments.starts)[pick] - window + 1, unit.bytes.tobytes()
    starts, count, keys = refined(segments.grams, window - gram + 1, starts, count, segments.keys[pick], shared.hot(replies)[pick])
    contents = [data[s:e] for s, e in zip(starts.tolist(), (starts + count + window - 1).tolist(), strict=True)]
    return starts, Sent(contents, keys, count, buckets)


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): docs without the bytes that a repeated window covers.

    Texts are UTF-8 bytes; kept is binary, as a cut may fall inside a character. A window is repeated if the same bytes start
    anywhere else, in the same document (overlaps count) or another; all are judged on the input. A null or empty
    text has no bytes. Repeated rows are documents of their own, null doc_ids too; other columns are ignored.
    """
    units = make_units(docs)
    count = max(1, units.count())
    buckets = max(1, -(-count // UNITS_PER_SHARD))
    partitions = max(buckets, scan_partitions(units))

    def send_keys(unit: Unit, _: list[Replies]) -> Iterator[tuple[int, bytes]]:
        return Segments(unit, window, gram).candidates(buckets).messages()

    def send_segments(unit: Unit, replies: list[Replies]) -> Iterator[tuple[int, bytes]]:
        return _sent(unit, replies[0], window, gram, buckets)[1].messages()

    def cut(unit: Unit, replies: list[Replies]) -> Iterator[pa.RecordBatch]:
        starts, sent = _sent(unit, replies[0], window, gram, buckets)
        segment, inside = sent.repeated(replies[1])
        hit = starts[segment] + inside
        change = np.zeros(len(unit.bytes) + 1, np.int32)
        change[hit] += 1  # starts are distinct
        change[hit + window] -= 1
        gone = np.cumsum(change[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(opens)])
        data, kept = unit.bytes[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])
        texts = [data[s:e] for s, e in zip(kept[unit.starts].tolist(), kept[unit.ends].tolist(), strict=True)]
        of = lambda x: pa.array(x[unit.ends] - x[unit.starts], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(unit.doc_ids, pa.int64()), pa.array(unit.ends - unit.starts, pa.int64()), of(removed), of(spans), pa.array(texts, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    first = ask(told(units, []), send_keys, in_several(np.uint32), partitions)
    second = ask(told(units, [first]), send_segments, compared(lambda texts, weights: repeated_starts(texts, weights, window)), partitions)
    return each_unit(told(units, [first, second]), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").drop("unit")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, removed bytes and spans, and the rest."""
    found = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    """The same rows by counting whole windows as strings of hex digits; doc_ids are unique."""
    return f"""
    with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    windows as (select doc_id, i, substr(h, 2 * i + 1, {2 * WINDOW}) as k from (select *, unnest(range(0, len(h) // 2 - {WINDOW - 1})) as i from d)),
    repeated as (select doc_id, i from windows where k in (select k from windows group by k having count(*) > 1)),
    steps as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from repeated),
    numbered as (select *, sum(case when before is null or i > before + {WINDOW} then 1 else 0 end) over (partition by doc_id order by i) as span from steps),
    spans as (select doc_id, span, min(i) as s, max(i) + {WINDOW} as e from numbered group by doc_id, span),
    gaps as (select doc_id, e as s, lead(s) over (partition by doc_id order by s) as e from spans union all select doc_id, 0, min(s) from spans group by doc_id),
    kept as (select g.doc_id, string_agg(substr(d.h, 2 * g.s + 1, 2 * (coalesce(g.e, len(d.h) // 2) - g.s)), '' order by g.s) as t from gaps g join d on g.doc_id = d.doc_id group by g.doc_id),
    sums as (select doc_id, sum(e - s) as n_removed, count(*) as n_spans from spans group by doc_id)
    select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(t, h))) as kept_sha256
    from d left join kept on d.doc_id = kept.doc_id left join sums on d.doc_id = sums.doc_id"""
