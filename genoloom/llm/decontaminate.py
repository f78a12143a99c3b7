"""Benchmark decontamination: winnowed fingerprints of both sides meet, and every hit is extended and compared word by word.

With k-grams of K words and the least hash of every W consecutive ones kept, two texts that share W + K - 1 words share
a kept fingerprint; K and W are chosen so that this is the length of a window. The benchmark's fingerprints reach the
documents as a bit table of fixed size; where one of a document's own is in it, the windows around it are joined with the
benchmark's windows, whose words decide. Neither side is ever whole in a task or in the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, table, whole_texts, written

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of a k-gram; of WINDOW - K + 1 consecutive ones the least hash is kept.
K = 5
#: Bits of the table of the benchmark's fingerprints, as a power of two: 8 MB, whatever the benchmark's size.
TABLE_BITS = 26

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_BASE, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text after A-Z were lower-cased: runs of ASCII letters, digits and all that isn't ASCII."""
    return _WORD((text or b"").lower())


class Texts:
    """The words of several texts after one another, their hashes, and how many words are left from each to its text's end."""

    def __init__(self, texts: list[bytes | None]):
        lists = [words(t) for t in texts]
        self.counts = np.array([len(w) for w in lists], np.int64)
        self.words = [w for own in lists for w in own]
        coded = pa.array(self.words, pa.large_binary()).dictionary_encode()
        known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
        self.hashes = known[coded.indices.to_numpy()] if self.words else known
        self.text = np.repeat(np.arange(len(lists)), self.counts)
        ends = np.cumsum(self.counts)
        self.starts = ends - self.counts
        self.room = ends[self.text] - np.arange(len(self.words))

    def grams(self, k: int) -> np.ndarray:
        """Hash of each k consecutive words of one text; the largest number where the text ends before."""
        n = len(self.words)
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out[: max(0, n - i)] = out[: max(0, n - i)] * _BASE + self.hashes[i:]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + np.uint64(k)
        out[out == _TOP] = np.uint64(0)
        out[self.room < k] = _TOP
        return out

    def window(self, at: int, size: int) -> bytes:
        return b" ".join(self.words[at : at + size])


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some w consecutive ones, ties included; a shorter input counts as one window."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    w = min(w, n)
    least = grams[: n - w + 1].copy()
    for i in range(1, w):
        np.minimum(least, grams[i : i + n - w + 1], out=least)
    best = np.zeros(n, np.uint64)  # the largest of the minima of the windows that hold a position
    for i in range(w):
        np.maximum(best[i : i + n - w + 1], least, out=best[i : i + n - w + 1])
    return np.flatnonzero((best == grams) & (grams != _TOP))


def _places(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a table of 2**width for each hash."""
    down = np.uint64(64 - width)
    return hashes >> down, (hashes * np.uint64(0xD6E8FEB86659FD93)) >> down


class Table:
    """The bits of the fingerprints, and the lengths of items shorter than a window."""

    def __init__(self, bits: np.ndarray, width: int, short: list[int]):
        self.bits, self.width, self.short = bits, width, short

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        a, b = _places(hashes, self.width)
        one = lambda x: (self.bits[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1)
        return (one(a) & one(b)).astype(bool)


def _benchmark(benchmark: DataFrame, window: int, k: int) -> tuple[DataFrame, Table]:
    """The benchmark's distinct windows (window, size, items), written, and the table of its fingerprints."""
    width = TABLE_BITS
    rows = whole_texts(benchmark).where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Texts(batch.column(1).cast(pa.binary()).to_pylist())
            ids = batch.column(0).to_numpy()
            size = np.minimum(t.counts, window)[t.text]
            at = np.flatnonzero(t.room >= size)
            yield pa.RecordBatch.from_arrays([pa.array([t.window(a, n) for a, n in zip(at.tolist(), size[at].tolist(), strict=True)], pa.binary()), pa.array(size[at].astype(np.int32)), pa.array(ids[t.text[at]])], ["window", "size", "item_id"])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Texts(batch.column(1).cast(pa.binary()).to_pylist())
            grams, long = t.grams(k), (t.counts >= window)[t.text]
            kept = winnowed(grams, window - k + 1)
            found = [grams[kept[long[kept]]]]
            for n in range(1, window):  # an item of n words is one gram
                own = t.starts[t.counts == n]
                found.append(t.grams(n)[own])
            place = np.unique(np.concatenate([p for h in found for p in _places(h, width)]))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["word", "bits"])

    windows = rows.mapInArrow(cut, "window binary, size int, item_id long")
    windows = written(windows.groupBy("window", "size").agg(F.collect_set("item_id").alias("items")), "windows")
    held = rows.mapInArrow(prints, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**20 rows
    bits = np.zeros(1 << (width - 6), np.uint64)
    bits[held["word"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    short = [r["size"] for r in windows.where(F.col("size") < window).select("size").distinct().collect()]  # fewer than a window's words
    return windows, Table(bits, width, sorted(short))


def _merged(runs: list[tuple[int, int]]) -> list[int]:
    """Sorted, disjoint runs as flat pairs."""
    out: list[int] = []
    for s, e in sorted(runs):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_hit, runs (flat pairs of word positions, end exclusive) and items (ids with a shared window).

    A null or empty text has no words. Of equal item_ids with several texts the id counts once; items without an id or a
    text are left out. Columns of docs with those four names are replaced. Every row is judged alone, repeated doc_ids
    too. Documents without a fingerprint in the table, nearly all, are never shuffled.
    """
    windows, fingerprints = _benchmark(benchmark, window, k)
    shared = docs.sparkSession.sparkContext.broadcast(fingerprints)  # of a fixed size
    docs = whole_texts(docs).drop("n_words", "n_hit", "runs", "items")
    columns, text_at = docs.columns, docs.columns.index("text")
    kept = [c for c in columns if keep_text or c != "text"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprints, row = shared.value, TaskContext.get().partitionId() << 33
        for batch in (whole.slice(a, 200) for whole in batches for a in range(0, whole.num_rows, 200)):
            t = Texts(batch.column(text_at).cast(pa.binary()).to_pylist())
            grams = t.grams(k)
            p = winnowed(grams, window - k + 1)
            p = p[fingerprints.hits(grams[p])]
            around = (p[:, None] - np.arange(window - k + 1)[None, :]).ravel()  # windows that hold the fingerprint
            around = np.unique(around[(around >= 0) & (around >= t.starts[t.text[np.repeat(p, window - k + 1)]])] if len(p) else around)
            found = [(around[t.room[around] >= window], window)]
            for n in fingerprints.short:
                grams = t.grams(n)
                found.append((np.flatnonzero((grams != _TOP) & fingerprints.hits(grams)), n))
            candidates: dict[int, list[dict]] = {}
            for at, n in found:
                for a, own in zip(at.tolist(), t.text[at].tolist(), strict=True):
                    candidates.setdefault(own, []).append({"start": a - int(t.starts[own]), "size": n, "window": t.window(a, n)})
            lists = pa.array([candidates.get(i) for i in range(batch.num_rows)], pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("window", pa.binary())])))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), *(batch.column(c) for c in kept), pa.array(t.counts), lists], ["_row", *kept, "n_words", "_candidates"])
            row += batch.num_rows

    schema = "_row long, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept) + "n_words long, _candidates array<struct<start:int,size:int,window:binary>>"
    marked = written(docs.mapInArrow(mark, schema), "marked")
    shown = [F.col(f"`{c}`") for c in kept]
    clear = marked.where("_candidates is null").select(*shown, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<int>").alias("runs"), F.array().cast("array<long>").alias("items"))
    some = marked.where("_candidates is not null")
    places = written(some.select("_row", F.explode("_candidates").alias("c")).select("_row", "c.*").withColumn("key", F.concat("window", F.lit(b" "), F.col("size").cast("string").cast("binary"))), "places")
    found = windows.select(F.concat("window", F.lit(b" "), F.col("size").cast("string").cast("binary")).alias("key"), "items")
    counts = places.groupBy("key").agg(F.count("*").alias("n"))
    matched = written(found.join(counts, "key"), "matched")
    rows = places.count()
    hits = join_by_key(places.select("_row", "start", "size", "key"), matched, "key", rows)
    by_row = hits.groupBy("_row").agg(F.collect_list(F.struct("start", "size")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [_merged([(x["start"], x["start"] + x["size"]) for x in spans]) for spans in batch.column(1).to_pylist()]
            hit = [sum(r[1::2]) - sum(r[::2]) for r in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array([sorted(x) for x in batch.column(2).to_pylist()], pa.list_(pa.int64()))], ["_row", "n_hit", "runs", "items"])

    extended = by_row.mapInArrow(extend, "_row long, n_hit long, runs array<int>, items array<long>")
    dirty = some.join(extended, "_row", "left").select(*shown, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("runs", F.array().cast("array<int>")).alias("runs"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))
    return clear.unionByName(dirty)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and items."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), keep_text=False)
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def oracle() -> str:
    """The same rows by joining whole windows as strings; doc_ids are unique."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    with d as (select doc_id, {words} as ws from documents), b as (select item_id, {words} as ws from benchmark),
    item_windows as (select distinct item_id, n, array_to_string(ws[i : i + n - 1], ' ') as k from (select *, unnest(range(1, len(ws) - n + 2)) as i from (select *, least({WINDOW}, len(ws)) as n from b where len(ws) > 0))),
    doc_windows as (select doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') as k from (select d.*, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from item_windows))),
    hits as (select doc_id, i, doc_windows.n, item_id from doc_windows join item_windows on doc_windows.n = item_windows.n and doc_windows.k = item_windows.k),
    hit_words as (select doc_id, count(distinct i + j) as n_hit from (select *, unnest(range(0, n)) as j from hits) group by doc_id),
    hit_items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from hits group by doc_id)
    select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
      sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join hit_words on d.doc_id = hit_words.doc_id left join hit_items on d.doc_id = hit_items.doc_id"""
