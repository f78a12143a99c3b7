import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.operators import custom
from genoloom.plans import engine, files, queries
from genoloom.sources import sinks

from conftest import SF


@pytest.fixture(scope="module")
def pedigree(spark):
    """Six generations of 40 animals each, some with one parent."""
    draw = np.random.default_rng(5)
    rows = [(k, None if k < 40 else int(draw.integers(0, k - k % 40)), None if k < 40 or k % 13 == 0 else int(draw.integers(0, k - k % 40))) for k in range(240)]
    ped = spark.createDataFrame(rows, "animal_id long, sire_id long, dam_id long")
    return ped, custom.generations(ped)


@pytest.mark.parametrize("limit", [2, 60, None])
def test_tables(spark, pedigree, limit):
    """tables of fewer animals than the pedigree has give the same; an animal with more ancestors than that gets its value too."""
    want = {r.animal_id: pytest.approx(r.f, abs=1e-12) for r in custom.inbreeding_levels(*pedigree).collect()}
    assert max(r.expected for r in want.values()) > 0.1
    assert {r.animal_id: r.f for r in custom.inbreeding_tabular(*pedigree, limit).collect()} == want


def test_columns(spark, pedigree, monkeypatch):
    """F6, F8: a task holds a bounded part of the matrix, whatever the number of animals; the matrix is the same."""
    widths, kept = [], custom.Pedigree.columns
    f = custom.inbreeding_levels(*pedigree)
    arrays = custom.Pedigree(*pedigree)
    d = arrays.variances(f.toPandas().set_index("animal_id")["f"].reindex(arrays.ids).to_numpy())
    whole = arrays.times(np.eye(240), d)
    assert np.allclose(kept(arrays, np.arange(240), d, arrays.steps()), whole)
    monkeypatch.setattr(custom, "COLUMN_ENTRIES", 1000)
    got = {(r.i, r.j): r.a for r in custom.relationship_columns(*pedigree, f).collect()}
    assert got == pytest.approx({(int(arrays.ids[i]), int(arrays.ids[j])): whole[i, j] for i in range(240) for j in range(240) if arrays.ids[i] >= arrays.ids[j] and whole[i, j] > 1e-12})


def test_matrix_unwritten(spark, monkeypatch):
    """the scan of triplets writes neither the matrix nor its blocks."""
    names = []
    for module in (engine, files):
        for one in ("stored", "fresh"):
            if (kept := getattr(module, one, None)) is not None:
                monkeypatch.setattr(module, one, lambda a, name, kept=kept: (names.append(name), kept(a, name))[1])
    assert queries.queries()["scan_triplets_bin"](spark, SF).first().n > 0 and not {"a_columns", "a_matrix"} & set(names)


def test_block_bytes():
    """F8: Parquet holds a hundred blocks at once at least."""
    assert 100 * 16 * sinks.BLOCK_ENTRIES <= 128 << 20


@pytest.mark.parametrize("entries", [0, 10**6])
def test_largest_residual(spark, entries):
    """one row that is off doesn't hide behind many that are right."""
    n = 2000
    a = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")).union(spark.createDataFrame([(1, 0, 0.9)], "i long, j long, v double"))
    b = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") == 0, 1.0).otherwise(1000.0).alias("y"))
    x = {r.i: r.x for r in custom.conjugate_gradient(a, b, tolerance=2e-2, entries=entries).collect()}
    assert max(abs(x[0] + 0.9 * x[1] - 1), abs(x[1] + 0.9 * x[0] - 1000)) <= 2e-2 * 1000
