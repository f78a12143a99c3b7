"""SimHash near-duplicates: fingerprints, blocking tables, and bit-sliced comparison within blocks.

Fingerprints of a block are stored as bit planes: word w of plane b holds bit b of 64 fingerprints. The distances of many
pairs grow together, plane by plane, in carry-save counters of a few bits each; a counter starts so that it
overflows just beyond the radius, and work goes on only for the words in which some pair hasn't overflowed yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, delete, join_by_key, table, whole_texts, written

SEED = 42
#: Fingerprints of a block that are compared in one piece; a larger block is dealt out as pairs of such pieces.
TILE = 2048
#: Fingerprints up to which one level of bands is used; beyond, bands within bands. Both find every link.
ONE_LEVEL = 1 << 22
#: Shingles of a class of candidates whose sets are compared in one piece; a larger class is dealt out as pairs of such pieces.
SET_TILE = 1 << 21
#: Sets up to which candidates also meet by shared shingles: fingerprints of few shingles differ more than those of many.
SHORT = 50
_PART = 1 << 16
#: Words of pairs that are compared together.
_WORDS = 1 << 15
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints

def shingle_hashes(text: bytes | None, n: int) -> np.ndarray:
    """XXH64 of each run of n words, space-joined; of the whole sequence if it is shorter; none without words."""
    parts = (text or b"").lower().split()  # bytes: only A-Z are lowered, and only ASCII white space parts words
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    joined, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[: len(parts) - n] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """64 * words bits: a bit is set if it is in over half the hashes; further words are remixed hashes."""
    out = []
    for word in range(words):
        h = hashes
        if word:
            h = (hashes + np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), _PART):
            bits = np.unpackbits(h[at : at + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * counts > len(h), bitorder="little").tobytes())
    return b"".join(out)[::-1]  # as a big-endian number


def signatures(docs: DataFrame, words: int = 3, fp_words: int = 1, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns and `fp` (binary, 8 * fp_words bytes) of each whole text; a null or empty text has all bits zero."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, words), fp_words) for t in batch.column(len(columns)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(fps, pa.binary())], [*columns, "fp"])

    rows = whole_texts(docs).select(*columns, "text")
    return rows.mapInArrow(sign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", fp binary")


# ---- bit-sliced comparison

def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes (bits, words of 64 fingerprints) of fps (n, bytes) as unsigned 64-bit words."""
    bits = np.unpackbits(fps, axis=1, bitorder="little").T
    pad = -bits.shape[1] % 64
    if pad:
        bits = np.pad(bits, ((0, 0), (0, pad)))
    return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view(np.uint64)


def within(differences, bits: int, shape: tuple[int, ...], radius: int, among: np.ndarray | None = None) -> np.ndarray:
    """Mask (shape) of the pairs at most radius apart. differences(b, keep): where bit b differs, at the flat words keep;
    among: words of the pairs that are asked for, all if None."""
    width = max(1, (radius + 1).bit_length())
    start = (1 << width) - (radius + 1)  # adding radius + 1 more overflows
    size = math.prod(shape)
    keep = np.arange(size) if among is None else np.flatnonzero(among)
    counters = [np.full(len(keep), _ONES if start >> k & 1 else np.uint64(0), np.uint64) for k in range(width)]
    over = np.zeros(size, np.uint64) if among is None else ~among[keep]
    for b in range(bits):
        carry = differences(b, keep)
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7 and b + 1 > radius:
            alive = over != _ONES
            left = int(alive.sum())
            if not left:
                return np.zeros(shape, np.uint64)
            if left < 0.7 * len(keep):
                keep, over, counters = keep[alive], over[alive], [c[alive] for c in counters]
    out = np.zeros(size, np.uint64)
    out[keep] = ~over
    return out.reshape(shape)


def _set_bits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the set bits of mask (rows, words)."""
    rows, words = np.nonzero(mask)
    if not len(rows):
        return rows, words
    bits = np.unpackbits(np.ascontiguousarray(mask[rows, words]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return rows[which], words[which] * 64 + bit


def block_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) at most radius apart: of two pieces of a block, or with right None of one (i < j)."""
    a, b = left, left if right is None else right
    sliced, width = planes(b), -(-len(b) // 64)
    query = np.unpackbits(a, axis=1, bitorder="little").astype(bool)
    found = ([], [])
    for at in range(0, len(a), 512):
        rows = query[at : at + 512]
        flip = np.where(rows, _ONES, np.uint64(0))

        def differences(bit, keep, flip=flip):
            return sliced[bit][keep % width] ^ flip[keep // width, bit]

        mask = within(differences, sliced.shape[0], (len(rows), width), radius)
        i, j = _set_bits(mask)
        ok = (j < len(b)) & ((i + at < j) if right is None else True)
        found[0].append(i[ok] + at)
        found[1].append(j[ok])
    return np.concatenate(found[0]), np.concatenate(found[1])


def near_links(groups: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one group at most radius apart; rows sorted by group. All groups are compared at once, row i
    with row i + d, for d up to the size of the largest: the planes against themselves, shifted by d bits, for many d together."""
    n = len(groups)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none
    room = np.searchsorted(groups, groups, "right") - np.arange(n)  # rows from here to the group's end
    sliced = planes(fps)
    words, most = sliced.shape[1], int(room.max())
    sliced = np.pad(sliced, ((0, 0), (0, most // 64 + 2)))
    step = max(1, _WORDS // words)
    found = ([none], [none])
    for first in range(1, most, step):
        d = np.arange(first, min(most, first + step))
        pairs = np.zeros((len(d), 64 * words), bool)
        pairs[:, :n] = room[None, :] > d[:, None]
        among = np.packbits(pairs, axis=1, bitorder="little").view(np.uint64).ravel()
        word = np.tile(np.arange(words), len(d))
        place = word + np.repeat(d // 64, words)
        low = np.repeat((d % 64).astype(np.uint64), words)
        high, one, last = np.uint64(63) - low, np.uint64(1), [None, None]

        def differences(bit, keep, word=word, place=place, low=low, high=high, one=one, last=last):
            if last[0] is not keep:
                last[:] = keep, (word[keep], place[keep], low[keep], high[keep])
            w, p, lo, hi = last[1]
            plane = sliced[bit]
            return plane[w] ^ ((plane[p] >> lo) | (plane[p + 1] << one << hi))

        at, bit = _set_bits(within(differences, sliced.shape[0], (len(d), words), radius, among))
        found[0].append(bit)
        found[1].append(bit + d[at])
    return np.concatenate(found[0]), np.concatenate(found[1])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links (a, b) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_roots(fps: np.ndarray, left: int, radius: int) -> np.ndarray:
    """For each fingerprint of a block the least one that links reach; links are between the first `left` and the others,
    or among all if left is their number.

    Whoever links two classes isn't wholly in the largest one, so only fingerprints outside it are compared with
    the rest: a block of thousands of near-copies costs a few rows of comparisons.
    """
    return _roots(len(fps), left, lambda rows, others: block_links(fps[rows], fps[others], radius))


def _roots(n: int, left: int, linked) -> np.ndarray:
    """block_roots of n rows; linked(rows, others) are the links (i, j) between rows[i] and others[j]."""
    root, asked, chunk = np.arange(n), np.zeros(n, bool), 64
    while True:
        largest = np.bincount(root, minlength=n).argmax()
        todo = np.flatnonzero(~asked & (root != largest))[:chunk]
        if not len(todo):
            return root
        asked[todo] = True
        a, b = [np.arange(n)], [root]
        if left == n:
            sides = [(todo, np.arange(n))]
        else:
            sides = [(todo[todo < left], np.arange(left, n)), (todo[todo >= left], np.arange(left))]
        for rows, others in sides:
            if len(rows):
                i, j = linked(rows, others)
                a.append(rows[i])
                b.append(others[j])
        root = spanning(n, np.concatenate(a), np.concatenate(b))
        chunk = min(512, 2 * chunk)


# ---- exact similarity

def prefix_keys(shingles: np.ndarray, similarity: float) -> list[int]:
    """Keys of a short set's least shingles: any two short sets with that Jaccard similarity or more share one of them."""
    n = len(shingles)
    if not 0 < n <= SHORT:
        return []
    return ((shingles[: n - math.ceil(similarity * n - 1e-9) + 1] >> np.uint64(2)) | np.uint64(1 << 62)).astype(np.int64).tolist()


def set_roots(sets: list[np.ndarray], left: int, similarity: float) -> np.ndarray:
    """block_roots of sets (distinct shingles): a link is an exact Jaccard similarity of `similarity` or more."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)[np.argsort(shingle, kind="stable")]
    count = np.bincount(shingle)
    first = np.cumsum(count) - count

    def linked(rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = ([], [])
        for i, row in enumerate(rows.tolist()):
            own = shingle[ends[row] - size[row] : ends[row]]
            many = count[own]
            at = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=n)[others]
            j = np.flatnonzero(both >= similarity * (size[row] + size[others] - both) - 1e-9)
            found[0].append(np.full(len(j), i))
            found[1].append(j)
        return np.concatenate(found[0]), np.concatenate(found[1])

    return _roots(n, left, linked)


# ---- blocking

def exact_tables(bits: int, radius: int, many: bool) -> list[np.ndarray]:
    """Bit positions of each table such that any two fingerprints at most radius apart agree on one table's.

    radius + 1 bands: one of them has no difference. With many fingerprints the other bits are cut again.
    """
    bands = np.array_split(np.arange(bits), radius + 1)
    if not many:
        return bands
    out = []
    for band in bands:
        rest = np.setdiff1d(np.arange(bits), band)
        out += [np.concatenate([band, part]) for part in np.array_split(rest, radius + 1)]
    return out


def sampled_tables(bits: int, agree: float, count: int, recall: float = 0.9999) -> list[np.ndarray]:
    """Tables of sampled bits for a radius that bands can't cover: two fingerprints that agree on each bit with
    probability `agree` meet in one of them with probability `recall` or more. Keys widen with the logarithm of
    the count, so that blocks stay small at every size."""
    width = max(12, math.ceil(math.log2(max(2, count)) - 6))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**width))
    chosen = np.random.default_rng(SEED)
    return [np.sort(chosen.choice(bits, width, replace=False)) for _ in range(tables)]


def links(fps: DataFrame, tables: list[np.ndarray], radius: int, more: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (column fp) that connect what lies at most radius apart.

    more: further keys (key, fp) by which fingerprints meet.

    Of each block only a spanning forest is returned, so edges grow with the fingerprints and not with pairs. Blocks
    beyond TILE are cut into pieces; each pair of pieces is a task of its own.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0)
            bits = np.unpackbits(np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1, bitorder="little").astype(np.int64)
            for t, positions in enumerate(tables):
                key = (bits[:, positions] << np.arange(len(positions))).sum(axis=1) + (t << 48)
                yield pa.RecordBatch.from_arrays([pa.array(key), values], ["key", "fp"])

    keys = fps.select("fp").mapInArrow(keyed, "key long, fp binary")
    rows = written(keys if more is None else keys.union(more), "keyed")
    large = rows.groupBy("key").count().where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    tiled = rows.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, sides, (values,) in _whole_groups(batches):
            yield from _compared(groups, sides, np.frombuffer(b"".join(values), np.uint8).reshape(len(groups), -1), radius)

    found = _dealt(tiled, "key", "fp").mapInArrow(compare, "src binary, dst binary").distinct()
    out = written(found, "links")
    delete(fps.sparkSession, rows._scratch_path)
    return out


def _dealt(tiled: DataFrame, key: str, node: str, *columns: str) -> DataFrame:
    """Rows of groups (key) cut into `tiles` pieces by node, sorted by pairs of pieces (key, a, b, side): node, columns."""
    own = F.pmod(F.xxhash64(node), F.col("tiles")).cast("int")
    pairs = tiled.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    pairs = pairs.select(key, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("side"), node, *columns)
    return pairs.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b", "side")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[bytes]]]]:
    """Batches cut so that no group (key, a, b) spans two of them: group numbers, sides, the other columns."""
    held: list[pa.RecordBatch] = []

    def grouped(t: pa.Table):
        cols = [t.column(i).to_numpy() for i in range(3)]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        side = t.column(3).to_numpy(zero_copy_only=False)
        return np.cumsum(change), side, [t.column(i).to_pylist() for i in range(4, t.num_columns)]

    last = lambda b, at: tuple(b.column(i)[at].as_py() for i in range(3))
    for batch in batches:
        if not batch.num_rows:
            continue
        end = last(batch, batch.num_rows - 1)
        if held and last(held[0], 0) == end:
            held.append(batch)
            continue
        # rows of the last group wait for the next batch
        cut = batch.num_rows - 1
        low, high = 0, cut
        while low < high:
            mid = (low + high) // 2
            if last(batch, mid) == end:
                high = mid
            else:
                low = mid + 1
        ready = [*held, batch.slice(0, low)]
        held = [batch.slice(low)]
        if (whole := pa.Table.from_batches(ready)).num_rows:
            yield grouped(whole)
    if held:
        yield grouped(pa.Table.from_batches(held))


def _compared(groups: np.ndarray, sides: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    size = np.bincount(groups)
    big = size > 128
    ends = np.cumsum(size)
    links_a, links_b = [], []
    small = np.flatnonzero(~big[groups])
    if len(small):
        a, b = near_links(groups[small], fps[small], radius)
        links_a.append(small[a])
        links_b.append(small[b])
    for g in np.flatnonzero(big):
        s, e = ends[g] - size[g], ends[g]
        left = int((~sides[s:e]).sum())
        root = block_roots(fps[s:e], left, radius) if left else np.arange(e - s)
        links_a.append(np.arange(s, e))
        links_b.append(root + s)
    if not links_a:
        return
    root = spanning(len(groups), np.concatenate(links_a), np.concatenate(links_b))
    tied = np.flatnonzero(root != np.arange(len(groups)))
    if len(tied):
        rows = [fps[i].tobytes() for i in tied], [fps[i].tobytes() for i in root[tied]]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.binary()) for r in rows], ["src", "dst"])


def roots(fps: DataFrame, radius: int, agree: float | None = None, more: DataFrame | None = None) -> DataFrame:
    """(fp, root) of distinct fingerprints: root is the same for all that links of at most radius reach.

    agree None: every link is found; else blocks are sampled for pairs that agree on a bit with that probability,
    and `more` (key, fp) are further blocks.
    """
    count = fps.count()
    bits = 8 * len(first.fp) if (first := fps.select("fp").first()) else 64
    tables = exact_tables(bits, radius, count > ONE_LEVEL) if agree is None else sampled_tables(bits, agree, count)
    tree = components(links(fps, tables, radius, more))
    return fps.join(tree, fps["fp"] == tree["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classes(signed: DataFrame, radius: int) -> DataFrame:
    """signed (of signatures, written) with `component_id`: the smallest doc_id whose fingerprint is reached over links.

    Equal fingerprints are one node, so copies cost a partial minimum and no pair. Null doc_ids take part in links;
    a class of null ids alone has a null component_id. An empty table gives no rows.
    """
    nodes = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    rooted = nodes.join(roots(nodes.select("fp"), radius), "fp")
    least, rows = _least_of_roots(rooted, "least"), nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_by_key(signed, written(least.select("fp", F.col("best").alias("component_id"), "n"), "classes"), "fp", rows)


def _least_of_roots(rooted: DataFrame, value: str) -> DataFrame:
    """rooted (root, value, ...) with `best`: the least value of each root, whose rows never meet in one task if it has many."""
    best = written(rooted.groupBy("root").agg(F.min(value).alias("best"), F.count("*").alias("n")), "best")
    rows = best.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = rooted.withColumnRenamed("n", "rows") if "n" in rooted.columns else rooted
    out = join_by_key(held, best, "root", rows)
    return out.withColumnRenamed("rows", "n")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over three-word shingles, and its class over links of three bits or fewer."""
    signed = written(signatures(table(spark, sf_dir, "documents")), "signed")
    number = F.lower(F.hex("fp"))
    return classes(signed, radius=3).select("doc_id", number.alias("fingerprint"), "component_id")


def set_signatures(docs: DataFrame, words: int, fp_words: int, similarity: float) -> DataFrame:
    """key, doc_id, fp, `sid` (of the set of shingles, 16 bytes), its `size` and its prefix_keys `prefix`."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            fps = [fingerprint(s, fp_words) for s in sets]  # of sets: repeats don't count, unlike op2's
            sids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            made = [pa.array(fps, pa.binary()), pa.array(sids, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([prefix_keys(s, similarity) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["key", "doc_id", "fp", "sid", "size", "prefix"])

    rows = whole_texts(docs).select("key", "doc_id", "text")
    return rows.mapInArrow(sign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", fp binary, sid binary, size long, prefix array<bigint>")


def confirmed(docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (src, dst) between the sets (nodes: sid, key of a text, size, root) that connect what is alike by the exact
    Jaccard similarity of whole sets, within classes of candidates (root). Sets are made again from the few texts concerned."""
    several = nodes.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / SET_TILE).cast("int").alias("tiles")).where("n > 1")
    several = written(several.select("root", F.greatest("tiles", F.lit(1)).alias("tiles"), "n"), "several")
    rows = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = join_by_key(nodes.select("key", "sid", "root"), several, "root", rows)
    rows = whole_texts(docs).select("key", "text").join(members, "key").select("root", "tiles", "sid", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(t, words)).tobytes() for t in batch.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], ["root", "tiles", "sid", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, sides, (sids, shingles) in _whole_groups(batches):
            src, dst = [], []
            cuts = np.flatnonzero(np.diff(groups, prepend=-1, append=groups[-1] + 1))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if left := int((~sides[s:e]).sum()):
                    root = set_roots([np.frombuffer(x, np.uint64) for x in shingles[s:e]], left, similarity)
                    for i in np.flatnonzero(root != np.arange(e - s)).tolist():
                        src.append(sids[s + i])
                        dst.append(sids[s + root[i]])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], ["src", "dst"])

    made = rows.mapInArrow(sets, "root binary, tiles int, sid binary, shingles binary")
    return _dealt(made, "root", "sid", "shingles").mapInArrow(compare, "src binary, dst binary").distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, fp_words: int = 4, slack: float = 4.5) -> DataFrame:
    """(key, doc_id, first_key) of the rows of docs (key, doc_id, text): classes of texts whose word shingles are alike.

    Links are pairs whose sets of distinct shingles have an exact Jaccard similarity of `similarity` or more; fingerprints only
    find the candidates. Two sets of similarity s have a cosine of 2 s / (1 + s), and SimHash bits differ with the probability
    of the angle over pi; the radius is the mean of that for `similarity` plus `slack` standard deviations, wide enough also for
    sets of four or five shingles, whose bits differ in 3 of 16 cases. first_key is the class's key of the smallest
    doc_id, nulls last, then the smallest key. Texts without words are one class. Blocks are sampled: of pairs just as alike as
    `similarity` whose fingerprints differ in the expected number of bits, 9,999 of 10,000 meet in one, and short sets always do.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * fp_words
    radius = round(bits * apart + slack * math.sqrt(bits * apart * (1 - apart)))
    signed = written(set_signatures(docs, words, fp_words, similarity), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    nodes = written(signed.groupBy("sid", "fp").agg(least.alias("least"), F.min("key").alias("key"), F.max("size").alias("size"), F.count("*").alias("n")), "nodes")
    short = signed.select(F.explode("prefix").alias("key"), "fp").distinct()
    candidates = nodes.drop("n").join(roots(written(nodes.select("fp").distinct(), "fps"), radius, 1 - apart, short), "fp")
    candidates = written(candidates.select("key", "sid", "size", "root"), "candidates")
    tree = components(written(confirmed(docs, candidates, words, similarity), "confirmed"))
    rooted = nodes.join(tree, nodes["sid"] == tree["node"], "left").select("sid", "least", "n", F.coalesce("root", "sid").alias("root"))
    first = _least_of_roots(rooted, "least").select("sid", F.col("best.key").alias("first_key"), "n")
    rows = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_by_key(signed.select("key", "doc_id", "sid"), written(first, "classes"), "sid", rows).drop("sid")
