"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The largest inner product becomes the nearest point by one more dimension, sqrt(M**2 - |x|**2) with M the largest norm. A tree is
fitted on a bounded sample; every vector goes to a leaf. A query walks the tree with a priority queue of nodes by the
distance of their centre. The number of leaves that it visits is widened until queries that the tree wasn't fitted on reach the
wanted recall, and for each query further, until the leaves hold as many candidates as it wants.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Vectors on which a tree is fitted: SAMPLE or, of more than SAMPLE**2 / 64, eight times the root of their number, so that leaves
#: grow more slowly than the table; SAMPLE_VALUES components at most. Of these, queries for the calibration.
SAMPLE, SAMPLE_VALUES, CALIBRATION = 16_384, 1 << 23, 256
BRANCHES = 8
#: Recall at which widening stops.
RECALL = 0.96
#: Distinct vectors of a block of candidates at most, and queries of a block.
BLOCK, QUERY_BLOCK = 8192, 16_384
SEED = 9


@dataclass
class Tree:
    """Centres and children by node (children empty: a leaf), leaf numbers by node, and leaves to visit."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    largest: float
    visits: int = 1

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0))])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each candidate, by the nearest centre on every level."""
        points, out = self.lifted(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                centres = self.centres[self.children[node]]
                near = ((centres * centres).sum(axis=1) - 2 * points[rows] @ centres.T).argmin(axis=1)
                todo += [(c, rows[near == k]) for k, c in enumerate(self.children[node])]
        return out

    def walk(self, query: np.ndarray, visits: int, held: np.ndarray | None = None, want: int = 0) -> list[int]:
        """Leaves in the order in which best bin first opens them: visits, and more until they hold `want` candidates."""
        norm = math.sqrt(float(query @ query))
        point = np.append(query * (self.largest / norm if norm else 0.0), 0.0)
        gap = ((self.centres - point) ** 2).sum(axis=1).tolist()
        queue, out, seen = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or seen < want):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
                seen += int(held[self.leaf[node]]) if held is not None else want
            for c in self.children[node]:
                heapq.heappush(queue, (gap[c], c))
        return out


def _k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        centres = np.stack([points[near == j].mean(axis=0) if (near == j).any() else points[rng.integers(len(points))] for j in range(k)])
    return centres


def fit(sample: np.ndarray, largest: float, k: int = 20, recall: float = RECALL, branches: int = BRANCHES, leaf_size: int = 64) -> Tree:
    """The tree of a sample (n, d) in random order. Its first CALIBRATION vectors (a quarter at most) aren't fitted on: they are the
    queries whose exact neighbours in the rest decide how many leaves are visited."""
    held = min(CALIBRATION, len(sample) // 4)
    asked, sample = sample[:held], sample[held:]
    rng = np.random.default_rng(SEED)
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), [[]], [-1], largest)
    points = tree.lifted(sample)
    centres, todo, made = [points.mean(axis=0) if len(points) else np.zeros(sample.shape[1] + 1)], [(0, np.arange(len(points)))], 0
    while todo:
        node, rows = todo.pop()
        distinct = len(np.unique(points[rows], axis=0)) if len(rows) > leaf_size else 0
        if distinct <= branches:
            tree.leaf[node] = made
            made += 1
            continue
        split = _k_means(points[rows], branches, rng)
        near = ((split * split).sum(axis=1) - 2 * points[rows] @ split.T).argmin(axis=1)
        for j in range(branches):
            tree.children[node].append(len(tree.children))
            tree.children.append([])
            tree.leaf.append(-1)
            centres.append(split[j])
            todo.append((len(tree.children) - 1, rows[near == j]))
    tree.centres = np.stack(centres)
    leaf, ranks = tree.assign(sample), []
    for query in asked:
        best = np.argsort(-(sample @ query), kind="stable")[:k]
        order = np.empty(tree.leaves, np.int64)
        order[tree.walk(query, tree.leaves)] = np.arange(tree.leaves)
        ranks += order[leaf[best]].tolist()
    if ranks:
        tree.visits = int(np.sort(ranks)[math.ceil(recall * len(ranks)) - 1]) + 1
    return tree


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part: none null, empty, zero or with a null or non-finite component."""
    v = F.col(column).cast("array<double>")
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(ok & F.col("id").isNotNull())


def _matrices(ids: pa.Array, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors of each length in a batch."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        at = pa.array(np.flatnonzero(sizes == n))
        yield ids.take(at).to_numpy(), column.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(n))


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(leaf, v, ids): distinct vectors with their `keep` smallest distinct ids, as no more copies can be among the nearest.

    Copies meet level by level, in a batch, among batches of equal salt, then all; no group is ever whole in a task.
    """

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            ids: dict[tuple[int, bytes], set[int]] = {}
            for i, v, leaf in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids.setdefault((leaf, v), set()).add(i)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in ids], pa.int64()), pa.array([k[1] for k in ids], pa.binary()), pa.array([sorted(x)[:keep] for x in ids.values()], pa.list_(pa.int64())), pa.array([n % 64] * len(ids), pa.int64())], ["leaf", "v", "ids", "salt"])

    first = rows.mapInArrow(collapse, "leaf long, v binary, ids array<long>, salt long").withColumn("salt", (F.col("salt") + F.spark_partition_id()) % 64)
    merged = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    return first.groupBy("leaf", "v", "salt").agg(merged).groupBy("leaf", "v").agg(merged)


def _forest(base: DataFrame, k: int, recall: float) -> tuple[dict[int, Tree], dict[int, int]]:
    """A tree for each length of vectors, and the number of its first leaf. Inner products exist only within a length."""
    norm = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    trees, first, made = {}, {}, 0
    for n, count, largest in sorted(base.groupBy(F.size("v")).agg(F.count("*"), norm).collect()):  # a row per length
        rows = max(BRANCHES, min(max(SAMPLE, math.ceil(8 * math.sqrt(count))), SAMPLE_VALUES // n))
        picked = base.where(F.size("v") == n).orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toArrow().column(0).combine_chunks()
        trees[n] = fit(picked.flatten().to_numpy(zero_copy_only=False).reshape(-1, n), largest * (1 + 1e-12), k, recall)
        first[n], made = made, made + trees[n].leaves
    return trees, first


_FOUND = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))


def _compare(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k nearest in a block of candidates of each query of a block, over the leaves that it visits."""
    names = ["query_id", "same", "found"]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], _FOUND)], names)
    leaf = right["leaf"].to_numpy()
    vectors, asked = right["v"].to_pylist(), left["q"].to_pylist()
    ids, own, same = right["ids"].to_pylist(), left["query_id"].to_pylist(), left["same"].to_pylist()
    opened = left["leaves"].combine_chunks()
    visitor, visited = np.repeat(np.arange(left.num_rows), opened.value_lengths().to_numpy()), opened.flatten().to_numpy()
    visitors = {key: visitor[visited == key] for key in np.unique(leaf).tolist()}
    length_of, asked_length = np.array([len(v) for v in vectors]), np.array([len(q) for q in asked])
    out = []
    for length in np.unique(asked_length).tolist():
        among = np.flatnonzero(length_of == length)
        if not len(among):
            continue
        x = np.frombuffer(b"".join(vectors[r] for r in among), np.float64).reshape(len(among), -1)
        rows_of = {key: np.flatnonzero(leaf[among] == key) for key in np.unique(leaf[among]).tolist()}
        queries = np.flatnonzero(asked_length == length)
        step = max(1, (1 << 22) // len(among))
        for at in range(0, len(queries), step):
            chosen_queries = queries[at : at + step]
            q = np.frombuffer(b"".join(asked[n] for n in chosen_queries), np.float64).reshape(len(chosen_queries), -1)
            near = np.full((len(chosen_queries), len(among)), -np.inf)
            for key, rows in rows_of.items():
                here = np.flatnonzero(np.isin(chosen_queries, visitors[key]))
                if len(here):
                    near[np.ix_(here, rows)] = q[here] @ x[rows].T
            for n, score, one in zip(chosen_queries.tolist(), near, q, strict=True):
                want = k + 1
                cut = np.partition(score, len(score) - want)[len(score) - want] if len(score) > want else -np.inf
                chosen = np.flatnonzero((score >= cut - 1e-9 * max(1.0, abs(cut))) & (score > -np.inf)) if cut > -np.inf else np.flatnonzero(score > -np.inf)
                exact = (x[chosen] * one).sum(axis=1)  # one order of summation, so that equal vectors tie
                best = heapq.nsmallest(k, ((-s, i) for s, r in zip(exact.tolist(), among[chosen].tolist(), strict=True) for i in ids[r] if i != own[n]))
                out.append((own[n], same[n], [{"score": -s, "vec_id": i} for s, i in best]))
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], _FOUND)], names)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """The k nearest candidates found of each query: (query_id, rank, vec_id, score), by score, ties to the smaller id.

    vectors and queries have vec_id and the vector column; rows of a query's own vec_id are no candidates of its. Vectors that
    take no part (see usable) are neither, and vectors of another length than the query's aren't among its candidates. Equal
    rows (id and vector) count once; other columns are ignored. With k candidates or fewer a query returns all. A query without
    any has no rows, and empty tables give none.
    """
    spark = vectors.sparkSession
    base = usable(vectors, column)
    trees, first = _forest(base, k, recall)
    shared = spark.sparkContext.broadcast((trees, first))  # its size is bounded by the samples

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, first = shared.value
        for batch in batches:
            for ids, x in _matrices(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(first[x.shape[1]] + trees[x.shape[1]].assign(x))], ["id", "v", "leaf"])

    members = written(_distinct(base.mapInArrow(assigned, "id long, v binary, leaf long"), k + 1), "members")
    sizes = {r.leaf: (r.n, r.ids) for r in members.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}  # a row per leaf
    # small leaves share a block, a large one is dealt out as several; a map of leaves is all that the driver holds
    most = min(BLOCK, max(256, -(-sum(n for n, _ in sizes.values()) // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    group_of, groups, room = {}, 0, 0
    for leaf, (n, _) in sorted(sizes.items()):
        if n > room:
            groups, room = groups + 1, max(n, most)
        group_of[leaf], room = groups, room - n
    blocks_of: dict[int, int] = {}
    for leaf, g in group_of.items():
        blocks_of[g] = max(blocks_of.get(g, 1), -(-sizes[leaf][0] // most))
    held = np.zeros(sum(t.leaves for t in trees.values()), np.int64)
    for leaf, (_, n) in sizes.items():
        held[leaf] = n

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, first = shared.value
        for batch in batches:
            out: list[tuple] = []
            for ids, x in _matrices(batch.column(0), batch.column(1)):
                if x.shape[1] not in trees:
                    continue
                tree, at = trees[x.shape[1]], first[x.shape[1]]
                own = held[at : at + tree.leaves]
                for i, q in zip(ids.tolist(), x, strict=True):
                    groups: dict[int, list[int]] = {}
                    for leaf in tree.walk(q, tree.visits, own, k + 1):
                        if at + leaf in group_of:
                            groups.setdefault(group_of[at + leaf], []).append(at + leaf)
                    out.append((i, q.tobytes(), [{"group": g, "blocks": blocks_of[g], "leaves": leaves} for g, leaves in groups.items()]))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            types = (pa.int64(), pa.binary(), pa.list_(pa.struct([("group", pa.int32()), ("blocks", pa.int32()), ("leaves", pa.list_(pa.int64()))])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["query_id", "q", "probe"])

    asked = usable(queries, column).distinct().mapInArrow(probes, "query_id long, q binary, probe array<struct<group:int,blocks:int,leaves:array<long>>>")
    asked = written(asked, "queries").select("query_id", F.xxhash64("q").alias("same"), "q", F.explode("probe").alias("p")).select("query_id", "same", "q", "p.*")
    # candidates go only to as many blocks of queries as visit them
    parts = asked.groupBy("group").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    cut = written(parts.join(spark.createDataFrame([(g, n) for g, n in blocks_of.items()], "group int, blocks int"), "group"), "blocks")
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(cut.select("group", "parts"), "group").withColumn("block", every("blocks")).withColumn("part", one("query_id", "parts"))
    leaves = spark.createDataFrame(list(group_of.items()), "leaf long, group int")
    right = members.join(leaves, "leaf").join(cut, "group").withColumn("block", one("v", "blocks")).withColumn("part", every("parts"))
    left, right = left.select("group", "block", "part", "query_id", "same", "q", "leaves"), right.select("group", "block", "part", "leaf", "v", "ids")
    keys = ("group", "block", "part")
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _compare(a, b, k), "query_id long, same long, found array<struct<score:double,vec_id:long>>")
    order = F.transform(F.flatten(F.collect_list("found")), lambda s: F.struct((-s["score"]).alias("less"), s["vec_id"].alias("vec_id")))
    best = partial.groupBy("query_id", "same").agg(F.slice(F.array_sort(order), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
