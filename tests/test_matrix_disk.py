"""What whole matrices take on disk, and that their rows stay the same in any order."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.operators import custom
from genoloom.plans import engine, files, queries

from conftest import SF


def _bytes(path: str, ending: str) -> int:
    return sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(ending))


@pytest.mark.parametrize(("weight", "places", "most"), [(0.95, 5, 4.5), (None, 4, 5.0)])
def test_result_is_small(spark, tmp_path, weight, places, most):
    """rows leave their blocks so that Parquet holds the values by a dictionary; before, a row took 8 and 7 bytes."""
    geno = engine.over_tables(spark, "/root/testdata/sf0.1", "geno")
    freq = engine.run(spark, "grm_p", geno=geno)
    out = str(tmp_path / "out")
    custom.genomic_products(geno, freq, weight, block=2000).select("i", "j", F.round("v", places).alias("v")).write.parquet(out)
    read = spark.read.parquet(out).toArrow()
    i, j, v = (read.column(c).to_numpy() for c in range(3))
    assert _bytes(out, ".parquet") / len(i) < most
    codes = np.full((2000, 64), np.nan)
    for r in geno.where("g is not null").collect():
        codes[r.animal_id, r.snp_idx - 1] = r.g
    p = np.nanmean(codes, axis=0) / 2
    z, k = np.nan_to_num(codes - 2 * p), (~np.isnan(codes)) @ (2 * p * (1 - p))
    whole = z @ z.T if weight is None else weight * z @ z.T / np.sqrt(np.outer(k, k)) + (1 - weight) * np.eye(2000)
    assert len(i) == 2000 * 2001 // 2 and (i <= j).all() and len(np.unique(i * 2000 + j)) == len(i)
    assert np.abs(whole[i, j] - v).max() < 0.51 * 10.0**-places


def test_blocks_are_ranges(spark):
    """ids of a block follow each other, whatever their order, sign and gaps; every pair of blocks meets in a task of its own."""
    ids = [int(x) for x in np.random.default_rng(4).permutation(np.arange(-300, 300) ** 3)]
    geno = spark.createDataFrame([(a, s, (a + s) % 3) for a in ids for s in (1, 2, 3)], "animal_id long, snp_idx int, g int")
    made = custom.Genotypes(geno, engine.run(spark, "grm_p", geno=geno), block=100)
    met = made.pairs(lambda same, one, two: custom._entries(same, one, two, custom._products(one, two)), "i long, j long, v double").withColumn("task", F.spark_partition_id())
    assert met.where("i > j").isEmpty() and met.select("i", "j").distinct().count() == met.count() == 600 * 601 // 2
    assert sorted(n for (n,) in met.groupBy("task").count().select("count").collect()) == [5050] * 6 + [10_000] * 15


@pytest.mark.parametrize("held", [1000, 1 << 21])
@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("kind", ["plain", "wide", "equal", "unknown"])
def test_any_order_is_whole(monkeypatch, held, same, kind):
    """frequent values leave first and rare ones last; no row is lost or doubled."""
    monkeypatch.setattr(custom, "HELD_ENTRIES", held)
    values = np.random.default_rng(5).normal(0, {"plain": 0.1, "wide": 1e4, "equal": 0, "unknown": 0.1}[kind], (300, 300))
    if kind == "unknown":
        values[7] = np.nan
    block = lambda first: type("", (), {"ids": np.arange(first, first + 300)})
    one, two = block(0), block(0 if same else 300)
    rows = [x for b in custom._entries(same, one, two, ((r, values[r : r + 150]) for r in (0, 150)), 5) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    got = {(i, j): v for i, j, v in rows}
    want = {(int(i), int(j)): values[a, b] for a, i in enumerate(one.ids) for b, j in enumerate(two.ids) if i <= j}
    assert len(rows) == len(want) and got.keys() == want.keys()
    assert np.array_equal([got[x] for x in want], [*want.values()], equal_nan=True)
    if kind == "plain" and not same:
        assert np.ptp([v for _, _, v in rows[: custom.PAGE_ROWS // 2]]) < np.ptp(values) / 2


def test_lines_are_compressed(spark, monkeypatch):
    """all lines of the matrix are written and read again, in a sixth of the bytes."""
    paths, kept = {}, files.fresh
    monkeypatch.setattr(files, "fresh", lambda spark, name: paths.setdefault(name, kept(spark, name)))
    assert queries.queries()["sink_g"](spark, SF).count() == 500 * 501 // 2 + 1000
    lines = spark.read.text(paths["g"])
    assert lines.count() == 500 * 501 // 2
    written = paths["g"].removeprefix("file:")
    assert _bytes(written, ".gz") > 0 and sum(map(len, (r.value for r in lines.collect()))) > 3 * _bytes(written, "")
