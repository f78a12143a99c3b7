import numpy as np
import pytest

from genoloom.operators import custom
from genoloom.plans import engine, queries

from conftest import SF

QUERIES = queries.queries()


@pytest.fixture
def written(monkeypatch):
    """Names of what a query writes on its way."""
    names, kept = [], engine.stored
    monkeypatch.setattr(engine, "stored", lambda df, name: (names.append(name), kept(df, name))[1])
    return names


@pytest.fixture
def made(monkeypatch):
    """How often all pairs of animals are made."""
    calls, kept = [], custom.genomic_products
    monkeypatch.setattr(custom, "genomic_products", lambda *a, **b: (calls.append(1), kept(*a, **b))[1])
    return calls


def test_products(spark, written):
    """products leave their blocks unwritten, an animal may lack rows of a marker, blocks of any size give the same."""
    QUERIES["grm_product"](spark, SF)
    assert not {"blocks", "grm_z"} & set(written)
    g = np.random.default_rng(2).integers(0, 3, (23, 9))
    rows = [(a * 5, s + 1, None if (a + s) % 4 == 0 else int(g[a, s])) for a in range(23) for s in range(9) if (a * s) % 11 != 3]
    geno = spark.createDataFrame(rows, "animal_id long, snp_idx int, g int")
    calls = np.full((23, 9), np.nan)
    for a, s, v in rows:
        calls[a // 5, s - 1] = np.nan if v is None else v
    z = np.nan_to_num(calls - np.nanmean(calls, axis=0))
    freq = engine.run(spark, "grm_p", geno=geno)
    for block in (None, 4):
        got = {(r.i, r.j): r.v for r in custom.genomic_products(geno, freq, block=block).collect()}
        assert got == pytest.approx({(5 * a, 5 * b): z[a] @ z[b] for a in range(23) for b in range(a, 23)}, abs=1e-9)
    with pytest.raises(Exception, match="several genotypes"):
        custom.genomic_products(geno.union(geno.limit(1)), freq).collect()


def test_blend_streams(spark, written):
    """scaling and blending happen in the blocks; neither products nor a join of them is written."""
    frame = QUERIES["grm_scale_blend"](spark, SF)
    assert not {"blocks", "grm_entries", "grm_z"} & set(written)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of blocks with blocks


def test_summary_streams(spark, written, made):
    """the matrix is summed up as it is made, once."""
    frame = QUERIES["matrix_summary"](spark, SF)
    assert not {"blocks", "grm_entries", "grm"} & set(written)
    assert len(made) == 1 and {r.part: r.n for r in frame.collect()} == {"diagonal": 500, "other": 500 * 499 // 2}


def test_blocks_are_small(spark):
    """a block goes to as many tasks as there are blocks, so a call takes less than half a byte."""
    geno = engine.over_tables(spark, SF, "geno")
    packed = custom.Genotypes(geno, engine.run(spark, "grm_p", geno=geno), block=100).packed.selectExpr("count(*)", "sum(length(ids) + length(codes))").first()
    assert packed[0] == 5 and packed[1] < 500 * 64 / 2


def test_diagonal_alone(spark, made):
    """no pairs are made for the diagonal."""
    assert QUERIES["g_diag_inbreeding"](spark, SF).count() == 500 and not made


def test_sink_g(spark, made):
    """the matrix is made once, for its lines."""
    assert QUERIES["sink_g"](spark, SF).count() == 500 * 501 // 2 + 1000 and len(made) == 1


@pytest.mark.parametrize("name", ["g_inverse_check", "g_inverse"])
def test_inverse_of_many(spark, monkeypatch, name):
    """more animals than one task inverts; by markers in blocks it is the inverse of the whole matrix."""
    monkeypatch.setattr(custom, "INVERSE_LIMIT", 100)
    monkeypatch.setattr(custom, "BLOCK", 130)
    got = QUERIES[name](spark, SF)
    if name == "g_inverse_check":
        assert {tuple(r) for r in got.collect()} == {(k, 1.0) for k in range(500)}
        return
    g, v = np.zeros((500, 500)), np.zeros((500, 500))
    for m, rows in ((g, engine.over_tables(spark, SF, "grm").toArrow()), (v, got.toArrow())):
        i, j, x = (rows.column(c).to_numpy() for c in range(3))
        m[i, j] = m[j, i] = x
    assert np.abs(np.einsum("ij,jk->ik", g, v) - np.eye(500)).max() < 1e-2  # entries have five places


def test_inverse_of_many_markers(spark, monkeypatch):
    """with more markers than their matrix may have, the whole matrix is inverted."""
    monkeypatch.setattr(custom, "INNER_LIMIT", 10)
    assert {tuple(r) for r in QUERIES["g_inverse_check"](spark, SF).collect()} == {(k, 1.0) for k in range(500)}
