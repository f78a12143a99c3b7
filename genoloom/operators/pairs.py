"""Pairs of animals over a marker panel: counts of many pairs at once, as products of blocks of genotypes.

A block of asking animals meets every block of the others; an animal's panel travels as one array and markers never meet in a
shuffle. Only pairs that some rule keeps leave a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import stored

#: Animals of a block.
BLOCK = 1024


def panel_arrays(geno: DataFrame, panel: DataFrame) -> DataFrame:
    """(animal_id, calls): an animal's genotypes over the panel in the order of its markers, as bytes; 3 is missing."""
    wide = geno.join(panel.select("snp_idx"), "snp_idx").groupBy("animal_id").agg(F.array_sort(F.collect_list(F.struct("snp_idx", F.coalesce("g", F.lit(3)).alias("g")))).alias("c"))
    return wide.select("animal_id", F.unhex(F.concat_ws("", F.transform("c", lambda x: F.lpad(F.hex(x["g"]), 2, "0")))).alias("calls"))


def _counts(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """Of every pair of rows: markers called in both, equal ones, opposite homozygotes, and the two sums of the relationship."""
    one = lambda x, g: (x == g).astype(np.float32)
    valid = one(a, 3) * -1 + 1, one(b, 3) * -1 + 1
    z = [np.where(x == 3, 0.0, x - 2 * p) for x in (a, b)]
    same = sum(one(a, g) @ one(b, g).T for g in range(3))
    return {
        "n_valid": np.rint(valid[0] @ valid[1].T).astype(np.int64),
        "n_same": np.rint(same).astype(np.int64),
        "n_errors": np.rint(one(a, 0) @ one(b, 2).T + one(a, 2) @ one(b, 0).T).astype(np.int64),
        "num": z[0] @ z[1].T,
        "denom": (valid[0] * (2 * p * (1 - p))) @ valid[1].T,
    }


def panel_pairs(asking: DataFrame, geno: DataFrame, panel: DataFrame, least: int, compat: float, equal: float, block: int = BLOCK) -> DataFrame:
    """(a, b, n_valid, n_same, n_errors, rel) of pairs of an asking animal a and any other b with `least` common calls or more, of
    which `compat` or more aren't opposite homozygotes or `equal` or more are equal."""
    wide = stored(panel_arrays(geno, panel), "panel_calls")
    frequency = [r.maf for r in panel.orderBy("snp_idx").select("maf").collect()]  # a row per panel marker
    blocks = max(1, -(-geno.select("animal_id").distinct().count() // block))
    asks = max(1, -(-asking.count() // block))
    shared = geno.sparkSession.sparkContext.broadcast(np.array(frequency, float))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.select("animal_id").distinct().join(wide, "animal_id").select(place("animal_id", asks).alias("x"), every(blocks).alias("y"), F.col("animal_id").alias("a"), F.col("calls").alias("one"))
    right = wide.select(every(asks).alias("u"), place("animal_id", blocks).alias("v"), F.col("animal_id").alias("b"), F.col("calls").alias("two"))

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        names = ["a", "b", "n_valid", "n_same", "n_errors", "rel"]
        types = [pa.int64()] * 5 + [pa.float64()]
        if not one.num_rows or not two.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        calls = [np.frombuffer(b"".join(t[c].to_pylist()), np.uint8).reshape(t.num_rows, -1) for t, c in ((one, "one"), (two, "two"))]
        ids = [one["a"].to_numpy(), two["b"].to_numpy()]
        c = _counts(*calls, shared.value)
        rate = lambda n: c[n] / np.maximum(c["n_valid"], 1)
        keep = (c["n_valid"] >= least) & (ids[0][:, None] != ids[1][None, :]) & ((1 - rate("n_errors") >= compat) | (rate("n_same") >= equal))
        i, j = np.nonzero(keep)
        rel = np.where(c["denom"][i, j] > 0, c["num"][i, j] / np.where(c["denom"][i, j] > 0, c["denom"][i, j], 1), np.nan)
        return pa.table([pa.array(v, t) for v, t in zip((ids[0][i], ids[1][j], c["n_valid"][i, j], c["n_same"][i, j], c["n_errors"][i, j], rel), types, strict=True)], names)

    return left.groupBy("x", "y").cogroup(right.groupBy("u", "v")).applyInArrow(compare, "a long, b long, n_valid long, n_same long, n_errors long, rel double")


def identity_pairs(asking: DataFrame, geno: DataFrame, panel: DataFrame, barred: DataFrame, least: int, equal: float, depth: int) -> DataFrame:
    """(a, b, n_valid, n_same) of the asking animals, of their mates, of the mates' mates and so on, `depth` steps far: b isn't barred."""
    frontier = seen = asking.select("animal_id").distinct()
    out = None
    for _ in range(depth + 1):
        found = panel_pairs(frontier, geno, panel, least, 2.0, equal).join(barred.select(F.col("animal_id").alias("b")), "b", "left_anti")
        found = stored(found.select("a", "b", "n_valid", "n_same"), "mates")
        out = found if out is None else out.unionByName(found)
        frontier = stored(found.select(F.col("b").alias("animal_id")).distinct().join(seen, "animal_id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return out
