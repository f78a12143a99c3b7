"""Operators that go round by round or in dense blocks: generations, ancestors, inbreeding, genomic products, inverses."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import engine
from ..plans.scratch import stored
from . import matrices, pedigree

#: Animals, and bytes of genotypes, of a block of the genomic products at most; rows of a product held at once, and entries of a batch that leaves a task.
BLOCK, BLOCK_BYTES, SLICE, BATCH_ENTRIES = 4096, 32 << 20, 512, 1 << 18
#: Rows that Parquet's first page may have, by which its writer keeps a dictionary or gives it up (20,000, and as many to spare); values of a dictionary
#: (131,072 at most); rows of other values that a task holds back for it.
PAGE_ROWS, DICTIONARY, HELD_ENTRIES = 40_000, 120_000, 1 << 21
#: The byte of a missing genotype.
MISSING = -128
#: Animals up to which a matrix is inverted: one task holds the matrix and its inverse, 1.6 GB at the limit.
INVERSE_LIMIT = 10_000
#: Animals up to which every task gets the whole pedigree as arrays (24 bytes an animal), beyond that ancestors are walked by joins.
PEDIGREE_LIMIT = 2_000_000
#: Entries of the relationship matrix that a task holds at once (32 MB).
COLUMN_ENTRIES = 1 << 22
#: Animals up to which a task holds a table of relationships (128 MB).
TABLE_LIMIT = 4000
#: Markers up to which the inverse of a genomic matrix goes by a matrix of markers (8 MB), whatever the number of animals.
INNER_LIMIT = 1024
#: Entries of a symmetric matrix up to which a system is solved in one task's arrays (100 bytes an entry).
ENTRY_LIMIT = 4_000_000
#: Markers up to which every task gets the counts of neighbouring genotypes (72 bytes a marker and distance).
MARKER_LIMIT = 200_000


def _parents(ped: DataFrame) -> DataFrame:
    one = lambda c: ped.where(f"{c} is not null").select("animal_id", F.col(c).alias("parent"))
    return one("sire_id").union(one("dam_id"))


def _cut(df: DataFrame) -> DataFrame:
    """df without its lineage."""
    return stored(df, "cut")


def generations(ped: DataFrame, most: int = 500) -> DataFrame:
    """(animal_id, gen): 0 for animals without children, a parent one more than its oldest child. Raises on a cycle."""
    parents, gen = _parents(ped), ped.select("animal_id", F.lit(0).alias("gen"))
    frontier = gen
    for _ in range(most):
        # only animals that were raised in the last round can raise their parents
        raised = _cut(frontier.join(parents, "animal_id").groupBy(F.col("parent").alias("animal_id")).agg((F.max("gen") + 1).alias("gen")))
        if raised.isEmpty():
            return gen
        gen = _cut(gen.union(raised).groupBy("animal_id").agg(F.max("gen").alias("gen")))
        frontier = raised
    raise ValueError("the pedigree has a cycle, or more generations than expected")


def contributions(ped: DataFrame, most: int = 500) -> DataFrame:
    """(animal_id, ancestor, v): share of each ancestor along every path, one generation a round; itself 1."""
    parents = _parents(ped).select(F.col("animal_id").alias("ancestor"), "parent")
    frontier = ped.select("animal_id", F.col("animal_id").alias("ancestor"), F.lit(1.0).alias("v"))
    total = frontier
    for _ in range(most):
        frontier = _cut(frontier.join(parents, "ancestor").groupBy("animal_id", F.col("parent").alias("ancestor")).agg((F.sum("v") / 2).alias("v")))
        if frontier.isEmpty():
            return total.groupBy("animal_id", "ancestor").agg(F.sum("v").alias("v"))
        total = total.union(frontier)
    raise ValueError("the pedigree has a cycle, or more generations than expected")


def inbreeding(ped: DataFrame, contrib: DataFrame, most: int = 100) -> DataFrame:
    """(animal_id, f), settled from variances and contributions: each round is exact for one more generation."""
    spark, contrib = ped.sparkSession, contrib
    f = ped.select("animal_id", F.lit(0.0).alias("f"))
    for _ in range(most):
        engine.RELATIONS.setdefault("f_next", pedigree.following("f_before"))
        new = _cut(engine.run(spark, "f_next", ped=ped, contrib=contrib, f_before=f))
        moved = new.alias("a").join(f.alias("b"), "animal_id").agg(F.max(F.abs(F.col("a.f") - F.col("b.f")))).first()[0]
        f = new
        if moved is None or moved < 1e-12:
            return f
    raise ValueError("inbreeding didn't settle")


def cycle_guard(ped: DataFrame) -> DataFrame:
    """ped rows (animal_id, sire_id, dam_id) without the parent links that lie on a cycle; all other links stay.

    Animals without parents or without children are peeled off until none is left to peel. In what remains the largest id that
    reaches an animal is its colour; an animal that reaches its colour's animal in turn is on a cycle with it, and so are
    the links between two such. They are cleared, the rest is peeled again, until nothing remains.
    """
    links, bad = _cut(_parents(ped).distinct()), []
    while True:
        while True:  # peel
            fewer = links.join(links.select(F.col("parent").alias("animal_id")).distinct(), "animal_id", "left_semi")
            fewer = _cut(fewer.join(fewer.select(F.col("animal_id").alias("parent")).distinct(), "parent", "left_semi").select("animal_id", "parent"))
            same, links = fewer.count() == links.count(), fewer
            if same:
                break
        if links.isEmpty():
            break
        colour = links.select("animal_id").distinct().withColumn("colour", F.col("animal_id"))
        while True:
            pushed = links.join(colour, "animal_id").select(F.col("parent").alias("animal_id"), "colour")
            new = _cut(colour.unionByName(pushed).groupBy("animal_id").agg(F.max("colour").alias("colour")))
            moved = new.join(colour.withColumnRenamed("colour", "was"), "animal_id", "left").where("was is null or was < colour").isEmpty()
            colour = new
            if moved:
                break
        ends = colour.select(F.col("animal_id").alias("parent"), F.col("colour").alias("parent_colour"))
        inside = _cut(links.join(colour, "animal_id").join(ends, "parent").where("colour = parent_colour").select("animal_id", "parent", "colour"))
        on = colour.where("animal_id = colour").select("animal_id")
        while True:
            more = inside.join(on.select(F.col("animal_id").alias("parent")), "parent", "left_semi").select("animal_id")
            wider = _cut(on.union(more).distinct())
            same, on = wider.count() == on.count(), wider
            if same:
                break
        looped = _cut(inside.join(on, "animal_id", "left_semi").join(on.select(F.col("animal_id").alias("parent")), "parent", "left_semi").select("animal_id", "parent"))
        bad.append(looped)
        links = _cut(links.join(looped, ["animal_id", "parent"], "left_anti"))
    if not bad:
        return ped.select("animal_id", "sire_id", "dam_id")
    cleared = bad[0]
    for more in bad[1:]:
        cleared = cleared.union(more)
    out = ped.select("animal_id", "sire_id", "dam_id")
    for c in ("sire_id", "dam_id"):
        out = out.join(cleared.select("animal_id", F.col("parent").alias(c), F.lit(True).alias(f"bad_{c}")), ["animal_id", c], "left").withColumn(c, F.when(F.col(f"bad_{c}").isNull(), F.col(c)))
    return out.select("animal_id", "sire_id", "dam_id")


# ---- pedigrees as arrays

class Pedigree:
    """Ids, places of sire and dam (-1: none) and generation of every animal; parents stand before their children."""

    def __init__(self, ped: DataFrame, gen: DataFrame, limit: int | None = None):
        limit = PEDIGREE_LIMIT if limit is None else limit
        held = ped.select("animal_id", "sire_id", "dam_id").join(gen, "animal_id").limit(limit + 1).toArrow()
        if held.num_rows > limit:
            raise ValueError(f"more than {limit} animals for one task's arrays")
        held = held.sort_by([("gen", "descending"), ("animal_id", "ascending")])
        self.ids = held["animal_id"].to_numpy()
        order = np.argsort(self.ids)

        def places(column: str) -> np.ndarray:
            known = held[column].is_valid().to_numpy()
            wanted = held[column].fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(self.ids, wanted, sorter=order), max(0, len(order) - 1))
            found = order[at] if len(order) else at
            return np.where(known & (self.ids[found] == wanted), found, -1) if len(order) else found

        self.sire, self.dam = places("sire_id"), places("dam_id")

    def levels(self) -> np.ndarray:
        """Of each animal its distance from the farthest founder: a level rests only on those below."""
        out = np.zeros(len(self.ids), np.int64)
        for i, (s, d) in enumerate(zip(self.sire.tolist(), self.dam.tolist(), strict=True)):
            out[i] = max(out[s] + 1 if s >= 0 else 0, out[d] + 1 if d >= 0 else 0)
        return out

    def variances(self, f: np.ndarray) -> np.ndarray:
        """Mendelian sampling variances: 1 without parents, 3/4 less a quarter of F with one, 1/2 less a quarter of both with two."""
        fs, fd = np.where(self.sire >= 0, f[self.sire], -1.0), np.where(self.dam >= 0, f[self.dam], -1.0)
        return 0.5 - 0.25 * (fs + fd)

    def times(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """A x for the relationship matrix A = T D T', by a sweep to the founders, a product, and a sweep back; x may have columns."""
        w = np.array(x, float)
        parents = list(zip(range(len(w)), self.sire.tolist(), self.dam.tolist(), strict=True))
        for i, s, m in reversed(parents):
            if s >= 0:
                w[s] += 0.5 * w[i]
            if m >= 0:
                w[m] += 0.5 * w[i]
        w = (w.T * d).T
        for i, s, m in parents:
            if s >= 0:
                w[i] += 0.5 * w[s]
            if m >= 0:
                w[i] += 0.5 * w[m]
        return w

    def ancestors(self, some: np.ndarray) -> np.ndarray:
        """Places of the given animals and all their ancestors, in order."""
        seen, now = np.zeros(len(self.ids), bool), np.unique(some)
        while len(now):
            seen[now] = True
            parents = np.unique(np.concatenate([self.sire[now], self.dam[now]]))
            now = parents[(parents >= 0) & ~seen[parents]]
        return np.flatnonzero(seen)

    def steps(self) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Of each level its animals with a sire and those sires, and the same of dams."""
        level = self.levels()
        ends = np.split(np.argsort(level, kind="stable"), np.cumsum(np.bincount(level))[:-1]) if len(level) else []
        return [[(at[p[at] >= 0], p[at[p[at] >= 0]]) for p in (self.sire, self.dam)] for at in ends[1:]]

    def columns(self, some: np.ndarray, d: np.ndarray, steps: list) -> np.ndarray:
        """The columns of A of some animals, as `times` has them of unit vectors: only their ancestors carry anything upwards, and a level
        goes down at once."""
        w = np.zeros((len(self.ids), len(some)))
        w[some, np.arange(len(some))] = 1
        up = self.ancestors(some)
        for i, s, m in zip(reversed(up.tolist()), reversed(self.sire[up].tolist()), reversed(self.dam[up].tolist()), strict=True):
            if s >= 0:
                w[s] += 0.5 * w[i]
            if m >= 0:
                w[m] += 0.5 * w[i]
        w[up] *= d[up, None]
        for step in steps:
            for child, parent in step:
                w[child] += 0.5 * w[parent]
        return w

    def inbreeding_of(self, i: int, d: np.ndarray) -> float:
        """The diagonal of A less 1: ancestors leave a queue youngest first, with all that reaches them summed up."""
        share, queue, total = {i: 1.0}, [-i], -1.0
        while queue:
            j = -heapq.heappop(queue)
            v = share.pop(j)
            total += v * v * d[j]
            for p in (int(self.sire[j]), int(self.dam[j])):
                if p >= 0:
                    if p not in share:
                        heapq.heappush(queue, -p)
                    share[p] = share.get(p, 0.0) + 0.5 * v
        return total


def inbreeding_levels(ped: DataFrame, gen: DataFrame) -> DataFrame:
    """(animal_id, f), one level of the pedigree a round: its animals' ancestors are walked in parallel, each with its own queue."""
    spark, arrays = ped.sparkSession, Pedigree(ped, gen)
    level, f = arrays.levels(), np.zeros(len(arrays.ids))
    for k in range(1, int(level.max(initial=0)) + 1):
        now = np.flatnonzero(level == k)
        shared = spark.sparkContext.broadcast((arrays, arrays.variances(f)))  # bounded by PEDIGREE_LIMIT

        def walk(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            arrays, d = shared.value
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([arrays.inbreeding_of(i, d) for i in batch.column(0).to_pylist()], pa.float64())], ["i", "f"])

        rows = spark.createDataFrame(pd.DataFrame({"i": now.astype("int64")})).repartition(spark.sparkContext.defaultParallelism if len(now) > 1000 else 1)
        got = rows.mapInArrow(walk, "i long, f double").toArrow()
        f[got["i"].to_numpy()] = got["f"].to_numpy()
    return spark.createDataFrame(pd.DataFrame({"animal_id": arrays.ids.astype("int64"), "f": f}), "animal_id long, f double")


def settled(ped: DataFrame, gen: DataFrame) -> DataFrame:
    """(animal_id, f): by levels over arrays, or where the pedigree is too large for them by joins."""
    if ped.count() <= PEDIGREE_LIMIT:
        return inbreeding_levels(ped, gen)
    return inbreeding(ped, _cut(contributions(ped)))


def inbreeding_tabular(ped: DataFrame, gen: DataFrame, limit: int | None = None) -> DataFrame:
    """(animal_id, f) by tables of relationships: a parent's row is half its own parents' rows, F half the relationship of both parents.

    A task tables the ancestors of some couples at a time, `limit` animals at most: of more, half the couples at a time. An animal with more
    ancestors than that has no table; those get their F level by level, as do pedigrees too large for arrays by joins.
    """
    limit = TABLE_LIMIT if limit is None else limit
    spark = ped.sparkSession
    if ped.count() > PEDIGREE_LIMIT:
        return settled(ped, gen)
    arrays = Pedigree(ped, gen)
    shared, f = spark.sparkContext.broadcast(arrays), np.zeros(len(arrays.ids))  # bounded by PEDIGREE_LIMIT
    both = np.flatnonzero((arrays.sire >= 0) & (arrays.dam >= 0))
    pairs, couple = np.unique(np.stack([arrays.sire[both], arrays.dam[both]], axis=1), axis=0, return_inverse=True)

    def tables(arrays: Pedigree, pairs: np.ndarray) -> np.ndarray:
        up = arrays.ancestors(pairs.ravel())
        if len(up) > limit:
            if len(pairs) == 1:
                return np.full(1, np.nan)
            return np.concatenate([tables(arrays, half) for half in np.array_split(pairs, 2)])
        sire, dam = (np.where(p[up] >= 0, np.searchsorted(up, p[up]), -1).tolist() for p in (arrays.sire, arrays.dam))
        a = np.zeros((len(up), len(up)))
        for i, (s, d) in enumerate(zip(sire, dam, strict=True)):
            row = sum((0.5 * a[p, :i] for p in (s, d) if p >= 0), np.zeros(i))
            a[i, :i] = a[:i, i] = row
            a[i, i] = 1 + (0.5 * a[s, d] if s >= 0 and d >= 0 else 0.0)
        return 0.5 * a[np.searchsorted(up, pairs[:, 0]), np.searchsorted(up, pairs[:, 1])]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tables(shared.value, np.stack([b.column(c).to_numpy() for c in (1, 2)], axis=1)))], ["k", "f"])

    rows = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(pairs)), "s": pairs[:, 0], "d": pairs[:, 1]}), "k long, s long, d long")
    got = rows.repartitionByRange(max(1, min(1000, len(pairs) // 256)), "k").mapInArrow(walk, "k long, f double").toArrow()
    of = np.zeros(len(pairs))
    of[got["k"].to_numpy()] = got["f"].to_numpy()
    f[both] = of[couple.ravel()]
    if np.isnan(f).any():
        held = inbreeding_levels(ped, gen).toArrow().to_pandas().set_index("animal_id")["f"]
        f = np.where(np.isnan(f), held.reindex(arrays.ids).to_numpy(), f)
    return spark.createDataFrame(pd.DataFrame({"animal_id": arrays.ids.astype("int64"), "f": f}), "animal_id long, f double")


def _with_arrays(ped: DataFrame, gen: DataFrame, f: DataFrame):
    arrays = Pedigree(ped, gen)
    held = f.toArrow().to_pandas().set_index("animal_id")["f"]  # bounded by PEDIGREE_LIMIT
    return ped.sparkSession.sparkContext.broadcast((arrays, arrays.variances(held.reindex(arrays.ids).to_numpy())))


def relationship_columns(ped: DataFrame, gen: DataFrame, f: DataFrame, least: float = 1e-12, block: int = 256) -> DataFrame:
    """(i, j, a) for i >= j by id: the relationship matrix, a block of its columns at a time from unit vectors. No ancestor is a join key."""
    shared = _with_arrays(ped, gen, f)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, d = shared.value
        order, steps, n = np.argsort(arrays.ids), arrays.steps(), len(arrays.ids)
        width = max(1, min(block, COLUMN_ENTRIES // max(1, n)))
        for batch in batches:
            wanted = batch.column(0).to_numpy()
            for at in range(0, len(wanted), width):
                some = order[np.searchsorted(arrays.ids, wanted[at : at + width], sorter=order)]
                y = arrays.columns(some, d, steps)
                rows = max(1, BATCH_ENTRIES // len(some))
                for r in range(0, n, rows):
                    ids = arrays.ids[r : r + rows]
                    i, j = np.nonzero((np.abs(y[r : r + rows]) > least) & (ids[:, None] >= arrays.ids[some][None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(arrays.ids[some][j]), pa.array(y[r : r + rows][i, j])], ["i", "j", "a"])

    animals = ped.select("animal_id")
    return animals.repartition(max(1, min(1000, animals.count() // 256)), "animal_id").mapInArrow(columns, "i long, j long, a double")


def relationship_times(ped: DataFrame, gen: DataFrame, f: DataFrame, x: DataFrame) -> DataFrame:
    """(animal_id, y) with y = A x, for x (animal_id, x), 0 where an animal has none."""
    arrays, d = _with_arrays(ped, gen, f).value
    held = x.toArrow().to_pandas().set_index("animal_id")["x"]  # bounded by PEDIGREE_LIMIT
    y = arrays.times(held.reindex(arrays.ids).fillna(0.0).to_numpy(), d)
    return ped.sparkSession.createDataFrame(pd.DataFrame({"animal_id": arrays.ids.astype("int64"), "y": y}), "animal_id long, y double")


# ---- matrices

class Genotypes:
    """Genotypes in blocks of animals whose ids follow each other: a row a block with its ids in order and a byte a call, in the order of the
    markers, both deflated: every block travels to as many tasks as there are blocks.

    Every pair of blocks meets once, and what a pair makes leaves its task in slices: no product is written between. An animal's
    calls travel once for each block, markers never meet in a shuffle.
    """

    def __init__(self, geno: DataFrame, freq: DataFrame, block: int | None = None):
        held = freq.where("snp_idx is not null").toArrow().sort_by("snp_idx")  # a row a marker
        self.markers, self.p = held["snp_idx"].to_numpy(), held["p"].to_numpy()
        calls = geno.where("animal_id is not null and snp_idx is not null")
        animals = calls.select("animal_id").distinct()
        n = animals.count()
        block = min(BLOCK, max(256, -(-n // 8)), max(1, BLOCK_BYTES // max(1, len(self.markers)))) if block is None else block
        self.spark, self.n, self.blocks = geno.sparkSession, n, max(1, -(-n // block))
        markers = self.spark.sparkContext.broadcast(self.markers)
        cuts = animals.select(F.percentile_approx("animal_id", [k / self.blocks for k in range(1, self.blocks)], 100_000)).first()[0] if n and self.blocks > 1 else []

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            lists = [rows[c].combine_chunks() for c in ("s", "g")]
            at = np.repeat(np.arange(rows.num_rows), lists[0].value_lengths().to_numpy())
            cells = at * len(markers.value) + np.searchsorted(markers.value, lists[0].flatten().to_numpy())
            if len(np.unique(cells)) < len(cells):
                raise ValueError("an animal has several genotypes of one marker")
            codes = np.full((rows.num_rows, len(markers.value)), MISSING, np.int8)
            codes.reshape(-1)[cells] = lists[1].flatten().to_numpy()
            order = np.argsort(rows["animal_id"].to_numpy())
            ids = rows["animal_id"].to_numpy().astype(np.int64)[order]
            return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (ids, codes[order]))], ["b", "ids", "codes"])

        lists = F.collect_list(F.struct("snp_idx", F.coalesce(F.col("g").cast("tinyint"), F.lit(MISSING).cast("tinyint")).alias("g")))
        wide = calls.groupBy("animal_id").agg(lists.alias("c")).select("animal_id", F.col("c.snp_idx").alias("s"), F.col("c.g").alias("g"))
        wide = wide.withColumn("b", sum((F.when(F.col("animal_id") > c, 1).otherwise(0) for c in cuts), F.lit(0)))
        self.packed = stored(wide.groupBy("b").applyInArrow(pack, "b int, ids binary, codes binary"), "genotype_blocks")

    def pairs(self, work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What work(same, left, right) yields for every pair of blocks; left and right: `Block`s."""
        packed, p = self.packed, self.spark.sparkContext.broadcast(self.p)
        left = packed.select("b", "ids", "codes", F.explode(F.sequence(F.col("b"), F.lit(self.blocks - 1))).alias("o"))
        right = packed.select(F.col("b").alias("o"), F.col("ids").alias("other_ids"), F.col("codes").alias("other_codes"))
        count = self.blocks * (self.blocks + 1) // 2
        number = F.expr(f"cast((b * (2L * {self.blocks} - b - 1) div 2 + o) % {min(count, 10_000)} as int)")  # up to 10,000 pairs have a task each
        met = left.join(right, "o").select("b", "o", "ids", "codes", "other_ids", "other_codes").repartitionById(min(count, 10_000), number)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    b, o, *held = (batch.column(c)[k] for c in range(6))
                    one, two = (Block(*(x.as_buffer() for x in held[c : c + 2]), p.value) for c in (0, 2))
                    yield from work(b.as_py() == o.as_py(), one, two)

        return met.mapInArrow(each, schema)


class Block:
    """The ids and genotypes of a block of animals; p: allele frequencies of the markers."""

    def __init__(self, ids: pa.Buffer, codes: pa.Buffer, p: np.ndarray):
        self.ids, self.p = np.frombuffer(zlib.decompress(ids), np.int64), p
        self.codes = np.frombuffer(zlib.decompress(codes), np.int8).reshape(len(self.ids), len(p))

    def z(self, rows: slice, markers: slice) -> np.ndarray:
        codes = self.codes[rows, markers]
        return np.where(codes == MISSING, 0.0, codes - 2 * self.p[markers])

    def k(self) -> np.ndarray:
        """Of each animal the sum of 2 p (1 - p) over its called markers."""
        step = range(0, len(self.ids), 256)
        return np.concatenate([(self.codes[r : r + 256] != MISSING) @ (2 * self.p * (1 - self.p)) for r in step]) if len(self.ids) else np.zeros(0)

    def scaled(self) -> np.ndarray:
        """U of U U': genomic relationships before blending."""
        u = self.z(slice(None), slice(None)) / np.sqrt(self.k())[:, None]
        if not np.isfinite(u).all():
            raise ValueError("an animal without any call at a marker that varies has no genomic relationships")
        return u


def _products(one: Block, two: Block) -> Iterator[tuple[int, np.ndarray]]:
    """The first row and the values of each slice of z z'."""
    for r in range(0, len(one.ids), SLICE):
        v = np.zeros((len(one.ids[r : r + SLICE]), len(two.ids)))
        for m in range(0, len(one.p), 1024):
            v += one.z(slice(r, r + SLICE), slice(m, m + 1024)) @ two.z(slice(None), slice(m, m + 1024)).T
        yield r, v


def _entries(same: bool, one: Block, two: Block, slices: Iterator[tuple[int, np.ndarray]], places: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, v), i <= j, of slices of values. With the places to which values will be rounded, rows leave in such an order that
    Parquet's writer keeps a dictionary of their values: the most frequent values first, and last those too far off for it."""
    middle, near, held, rare = np.nan, np.nan, [], 0
    batch = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "v"])
    reach = np.inf if places is None else DICTIONARY / 2 * 10.0**-places
    for n, (first, values) in enumerate(slices):
        step = max(1, BATCH_ENTRIES // max(1, len(two.ids)))
        if n == 0 and places is not None and values.size > PAGE_ROWS:
            middle = np.median(values)
            near = np.partition(np.abs(values - middle), PAGE_ROWS, axis=None)[PAGE_ROWS]
        passes = [True, False] if n == 0 and near >= 0 else [False]
        for frequent in passes:
            for r in range(0, len(values), step):
                v = values[r : r + step]
                a = np.repeat(one.ids[first + r : first + r + len(v)], len(two.ids))
                b, v = np.tile(two.ids, len(v)), v.ravel()
                off = np.abs(v - middle)
                keep = (off <= near) == frequent if len(passes) > 1 else np.ones(len(v), bool)
                if same:
                    keep &= a <= b
                if not keep.all():
                    a, b, v, off = a[keep], b[keep], v[keep], off[keep]
                far = off > reach
                if far.any():
                    held.append((a[far], b[far], v[far]))
                    rare += len(held[-1][0])
                    a, b, v = a[~far], b[~far], v[~far]
                yield batch(a, b, v)
                if rare > HELD_ENTRIES:  # too many for any dictionary
                    yield from (batch(*x) for x in held)
                    held, reach = [], np.inf
    yield from (batch(*x) for x in held)


def _relationships(same: bool, one: Block, two: Block, weight: float) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of the scaled products, blended with the identity."""
    ka, kb = one.k(), two.k()
    for r, v in _products(one, two):
        with np.errstate(all="ignore"):
            v = weight * v / np.sqrt(ka[r : r + len(v), None] * kb[None, :])
        if same:
            v[np.arange(len(v)), np.arange(r, r + len(v))] += 1 - weight
        yield r, v


def genomic_products(geno: DataFrame, freq: DataFrame, weight: float | None = None, block: int | None = None) -> DataFrame:
    """(i, j, v) for i <= j: sums over markers of z_i z_j, from geno (animal_id, snp_idx, g) and allele frequencies (snp_idx, p); with a
    weight scaled by both animals' sums of 2 p (1 - p) and blended with the identity. Queries round the former to 4 places, the latter to 5."""

    def multiply(same: bool, one: Block, two: Block) -> Iterator[pa.RecordBatch]:
        yield from _entries(same, one, two, _products(one, two) if weight is None else _relationships(same, one, two, weight), 4 if weight is None else 5)

    return Genotypes(geno, freq, block).pairs(multiply, "i long, j long, v double")


def inverse(g: DataFrame, limit: int | None = None) -> DataFrame:
    """(i, j, v) for i <= j of the inverse of the symmetric (i, j, g); one task, so only up to `limit` animals."""
    limit = INVERSE_LIMIT if limit is None else limit
    n = g.where("i = j").count()
    if n > limit:
        raise ValueError(f"{n} animals; an inverse is made for up to {limit}")
    ids = np.array(sorted(r.i for r in g.where("i = j").select("i").collect()), np.int64)  # at most `limit`

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((len(ids), len(ids)))
        for b in batches:  # entries go into the matrix as they come
            i, j = np.searchsorted(ids, b.column(0).to_numpy()), np.searchsorted(ids, b.column(1).to_numpy())
            m[i, j] = m[j, i] = b.column(2).to_numpy()
        m = np.linalg.inv(m) if len(ids) else m
        for k in range(len(ids)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids) - k, ids[k])), pa.array(ids[k:]), pa.array(m[k, k:])], ["i", "j", "v"])

    return g.select("i", "j", F.col("g").cast("double")).repartition(1).mapInArrow(invert, "i long, j long, v double")


class MarkerInverse:
    """The inverse of the genomic matrix w U U' + (1 - w) I of any number of animals, by a matrix of markers: it is
    (I - U C U') / (1 - w) with C = (U'U + (1 - w) / w I)^-1, so that its blocks are products of blocks again."""

    def __init__(self, geno: DataFrame, freq: DataFrame, weight: float):
        self.genotypes, self.weight = Genotypes(geno, freq), weight
        markers = len(self.genotypes.markers)
        p = self.genotypes.spark.sparkContext.broadcast(self.genotypes.p)

        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((markers, markers))
            for batch in batches:
                for ids, codes in zip(batch.column(0), batch.column(1), strict=True):
                    u = Block(ids.as_buffer(), codes.as_buffer(), p.value).scaled()
                    total += u.T @ u
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = (1 - weight) / weight * np.eye(markers)
            for batch in batches:
                for m in batch.column(0):
                    total += np.frombuffer(m.as_buffer(), float).reshape(markers, markers)
            yield pa.RecordBatch.from_arrays([pa.array([np.linalg.inv(total).tobytes()], pa.binary())], ["m"])

        parts = self.genotypes.packed.select("ids", "codes").coalesce(8).mapInArrow(squares, "m binary")  # 8 MB each at most
        held = parts.repartition(1).mapInArrow(invert, "m binary").first().m
        self.inner = self.genotypes.spark.sparkContext.broadcast(np.frombuffer(held, float).reshape(markers, markers))

    @staticmethod
    def fits(freq: DataFrame, weight: float) -> bool:
        return 0 < weight < 1 and freq.count() <= INNER_LIMIT

    def _slices(self) -> Callable[..., Iterator[tuple[int, np.ndarray]]]:
        inner, weight = self.inner, self.weight

        def slices(same: bool, one: Block, two: Block) -> Iterator[tuple[int, np.ndarray]]:
            left, right = one.scaled() @ inner.value, two.scaled().T
            for r in range(0, len(one.ids), SLICE):
                v = left[r : r + SLICE] @ right / (weight - 1)
                if same:
                    v[np.arange(len(v)), np.arange(r, r + len(v))] += 1 / (1 - weight)
                yield r, v

        return slices

    def entries(self) -> DataFrame:
        """(i, j, v) for i <= j."""
        slices = self._slices()
        return self.genotypes.pairs(lambda same, one, two: _entries(same, one, two, slices(same, one, two)), "i long, j long, v double")

    def diagonal(self) -> DataFrame:
        """(animal_id, one): parts of the diagonal of the matrix times its inverse, one from each block that the animal meets."""
        slices, weight = self._slices(), self.weight

        def sums(same: bool, one: Block, two: Block) -> Iterator[pa.RecordBatch]:
            across, down = np.zeros(len(one.ids)), np.zeros(len(two.ids))
            for (r, g), (_, v) in zip(_relationships(same, one, two, weight), slices(same, one, two), strict=True):
                both = g * v
                across[r : r + len(g)] = both.sum(axis=1)
                down += both.sum(axis=0)
            for ids, part in ((one.ids, across),) if same else ((one.ids, across), (two.ids, down)):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part)], ["animal_id", "one"])

        return self.genotypes.pairs(sums, "animal_id long, one double")


def genomic_inverse(geno: DataFrame, freq: DataFrame, weight: float) -> DataFrame:
    """(i, j, v) for i <= j of the inverse of the genomic matrix: by a matrix of markers, or where they are too many whole in one task."""
    if MarkerInverse.fits(freq, weight):
        return MarkerInverse(geno, freq, weight).entries()
    return inverse(stored(genomic_products(geno, freq, weight).withColumnRenamed("v", "g"), "grm"))


def inverse_diagonal(geno: DataFrame, freq: DataFrame, weight: float) -> DataFrame:
    """(animal_id, one): parts of the diagonal of the genomic matrix times its inverse."""
    if MarkerInverse.fits(freq, weight):
        return MarkerInverse(geno, freq, weight).diagonal()
    g = stored(genomic_products(geno, freq, weight).withColumnRenamed("v", "g"), "grm")
    met = stored(g.join(inverse(g), ["i", "j"]).select("i", "j", (F.col("g") * F.col("v")).alias("one")), "products")
    return met.select(F.col("i").alias("animal_id"), "one").union(met.where("i <> j").select("j", "one"))


def _solved_in_arrays(a: DataFrame, b: DataFrame, most: int, tolerance: float) -> DataFrame:
    rows = a.select(F.lit(0).alias("kind"), "i", "j", F.col("v").cast("double").alias("v")).union(b.select(F.lit(1), "i", "i", F.col("y").cast("double")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches] or [[np.zeros(0, np.int64)] * 4]
        kind, i, j, v = (np.concatenate([part[c] for part in parts]) for c in range(4))
        ids = np.unique(i[kind == 1])
        y = np.zeros(len(ids))
        y[np.searchsorted(ids, i[kind == 1])] = v[kind == 1]
        i, j, v = np.searchsorted(ids, i[kind == 0]), np.searchsorted(ids, j[kind == 0]), v[kind == 0]
        other = i != j
        rows, columns, values = np.concatenate([i, j[other]]), np.concatenate([j, i[other]]), np.concatenate([v, v[other]])
        m = np.bincount(i[~other], weights=v[~other], minlength=len(ids))
        x, r = np.zeros(len(ids)), y.copy()
        p, rz, bb = r / m, float(r @ (r / m)), float(y @ y)
        times = lambda q: np.bincount(rows, weights=values * q[columns], minlength=len(ids))
        small = lambda r: float(r @ r) <= tolerance**2 * bb
        even = lambda r: np.abs(r).max() <= tolerance * np.abs(y).max()
        last = np.inf
        for _ in range(most):
            if not rz:
                break
            if small(r) and even(r):
                r = y - times(x)  # what was carried on drifts from it by rounding; solved again for what is left, until that helps no more
                if small(r) and (even(r) or np.abs(r).max() > last / 2):
                    break
                p, rz, last = r / m, float(r @ (r / m)), np.abs(r).max()
            ap = times(p)
            step = rz / float(p @ ap)
            x, r = x + step * p, r - step * ap
            new = float(r @ (r / m))
            p, rz = r / m + new / rz * p, new
        else:
            if len(ids) and not small(y - times(x)):
                raise ValueError(f"not solved in {most} rounds")
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x)], ["i", "x"])

    return rows.repartition(1).mapInArrow(solve, "i long, x double")


def conjugate_gradient(a: DataFrame, b: DataFrame, most: int = 10_000, tolerance: float = 1e-9, entries: int | None = None) -> DataFrame:
    """(i, x) with a x = b, for a symmetric positive definite (i, j, v), i >= j or i <= j once each, and b (i, y).

    Jacobi-preconditioned, until both the norm of the residual and its largest value are `tolerance` of those of b: by the norm alone a
    single row may be off by more the more rows there are. Raises if `most` rounds don't get there. Up to `entries` entries are solved in one task's arrays; beyond, every product is a join and a sum,
    and only scalars come to the driver.
    """
    if a.count() <= (ENTRY_LIMIT if entries is None else entries):
        return _solved_in_arrays(a, b, most, tolerance)
    full = _cut(a.union(a.where("i <> j").select(F.col("j"), F.col("i"), "v")))
    m = full.where("i = j").select("i", F.col("v").alias("m"))
    state = _cut(b.join(m, "i").select("i", F.lit(0.0).alias("x"), F.col("y").alias("r"), (F.col("y") / F.col("m")).alias("p"), "m"))
    rz, bb, largest = state.agg(F.sum(F.col("r") * F.col("r") / F.col("m")), F.sum(F.col("r") * F.col("r")), F.max(F.abs("r"))).first()
    for _ in range(most):
        if not bb or not rz:
            break
        ap = full.join(state.select(F.col("i").alias("j"), "p"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("p")).alias("ap"))
        joined = state.join(ap, "i")
        alpha = rz / joined.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        stepped = joined.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p", "m")
        new, rr, left = stepped.agg(F.sum(F.col("r") * F.col("r") / F.col("m")), F.sum(F.col("r") * F.col("r")), F.max(F.abs("r"))).first()
        state = _cut(stepped.withColumn("p", F.col("r") / F.col("m") + (new / rz) * F.col("p")))
        rz = new
        if rr <= tolerance**2 * bb and left <= tolerance * largest:
            break
    else:
        raise ValueError(f"not solved in {most} rounds")
    return state.select("i", "x")


# ---- fills

def ld_fill(geno: DataFrame, own: DataFrame, counts: DataFrame, window: int = 3) -> DataFrame:
    """(animal_id, snp_idx, g) of the cells that were missing, filled left to right: a filled cell counts for those after it.

    own: genotype counts of each marker (snp_idx, g, n); counts: those beside each neighbour (snp_idx, distance, neighbour, g, n). An
    animal is one row of genotypes; a batch of animals goes marker by marker. Ties go to the smaller genotype.
    """
    spark = geno.sparkSession
    markers = np.array([r.snp_idx for r in geno.select("snp_idx").distinct().orderBy("snp_idx").limit(MARKER_LIMIT + 1).collect()], np.int64)
    if len(markers) > MARKER_LIMIT:
        raise ValueError(f"more than {MARKER_LIMIT} markers in one chromosome set; fill them by parts")
    at = lambda t, c: np.searchsorted(markers, t[c].to_numpy())
    freq, near = np.zeros((len(markers), 3), np.int64), np.zeros((len(markers), 2 * window + 1, 3, 3), np.int64)
    held = own.toArrow()  # three rows a marker
    freq[at(held, "snp_idx"), held["g"].to_numpy()] = held["n"].to_numpy()
    held = counts.toArrow()  # nine rows a marker and distance
    near[at(held, "snp_idx"), held["distance"].to_numpy() + window, held["neighbour"].to_numpy(), held["g"].to_numpy()] = held["n"].to_numpy()
    shared = spark.sparkContext.broadcast((markers, freq, near))
    calls = F.array_sort(F.collect_list(F.struct("snp_idx", F.coalesce("g", F.lit(3)).alias("g"))))
    wide = geno.groupBy("animal_id").agg(calls.alias("c")).select("animal_id", F.transform("c", lambda x: x["snp_idx"]).alias("s"), F.transform("c", lambda x: x["g"]).alias("g"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        markers, freq, near = shared.value
        place = {s: k for k, s in enumerate(markers.tolist())}
        for whole in batches:
            for b in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                now = np.full((b.num_rows, len(markers)), 9, np.int8)  # 9: the animal lacks the marker
                rows = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
                now[rows, np.searchsorted(markers, b.column(1).flatten().to_numpy())] = b.column(2).flatten().to_numpy()
                out = []
                for s in np.flatnonzero((now == 3).any(axis=0) & freq.any(axis=1)).tolist():
                    todo = np.flatnonzero(now[:, s] == 3)
                    score = np.repeat(freq[s][None, :], len(todo), axis=0)
                    for d in range(-window, window + 1):
                        beside = place.get(int(markers[s]) + d) if d else None
                        if beside is not None:
                            g = now[todo, beside]
                            known = g < 3
                            score[known] += near[s, d + window, g[known]]
                    best = score.argmax(axis=1)
                    now[todo, s] = best
                    out.append((todo, np.full(len(todo), markers[s]), best))
                ids = b.column(0).to_numpy()
                parts = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[parts[0]], pa.int64()), pa.array(parts[1], pa.int32()), pa.array(parts[2], pa.int32())], ["animal_id", "snp_idx", "g"])

    return wide.mapInArrow(fill, "animal_id long, snp_idx int, g int")


engine.STREAMED.update(("blocks", "grm_entries", "a_columns", "inverted"))
_made = engine.PYTHON.update
_made({
    "traced": (("ped",), lambda p, ped: generations(ped)),
    "walked": (("ped",), lambda p, ped: contributions(ped)),
    "settled": (("ped", "traced"), lambda p, ped, traced: settled(ped, traced)),
    "levelled": (("ped", "traced"), lambda p, ped, traced: inbreeding_levels(ped, traced)),
    "tabled": (("ped", "traced"), lambda p, ped, traced: inbreeding_tabular(ped, traced)),
    "a_columns": (("ped", "traced", "settled"), lambda p, ped, traced, settled: relationship_columns(ped, traced, settled)),
    "a_times": (("ped", "traced", "settled", "a_vector"), lambda p, ped, traced, settled, a_vector: relationship_times(ped, traced, settled, a_vector)),
    "guarded": (("ped_cyclic",), lambda p, ped_cyclic: cycle_guard(ped_cyclic)),
    "blocks": (("geno", "grm_p"), lambda p, geno, grm_p: genomic_products(geno, grm_p)),
    "grm_entries": (("geno", "grm_p"), lambda p, geno, grm_p: genomic_products(geno, grm_p, float(p["weight"]))),
    "inverted": (("geno", "grm_p"), lambda p, geno, grm_p: genomic_inverse(geno, grm_p, float(p["weight"]))),
    "inverse_ones": (("geno", "grm_p"), lambda p, geno, grm_p: inverse_diagonal(geno, grm_p, float(p["weight"]))),
    "ld_fills": (("windowed",), lambda p, windowed: _ld_fills(p, windowed)),
    "ld_filled": (("geno",), lambda p, geno: _ld_fills(p, geno)),
    "solved": (("a_inv", "ped"), lambda p, a_inv, ped: conjugate_gradient(a_inv, ped.select(F.col("animal_id").alias("i"), F.col("byr").cast("double").alias("y")), tolerance=1e-6)),
})


def _ld_fills(parameters: dict, geno: DataFrame) -> DataFrame:
    geno = _cut(geno)
    own, counts = (engine.run(geno.sparkSession, n, parameters, geno=geno) for n in ("snp_g", "ld_counts"))
    return ld_fill(geno, own, counts, int(parameters["ld_window"]))
