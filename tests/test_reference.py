"""Every reference query against its SQL in DuckDB, identities, and readers and writers."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import genoloom.plans.queries as Q
from genoloom.functions import text as X
from genoloom.operators import custom
from genoloom.plans import engine
from genoloom.sources import parameters, sinks, text
from genoloom.streaming import counts

SF = "/root/testdata/sf0.001"
QUERIES, SQL = Q.queries(), Q.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(df):
    def one(v):
        if v is None or v is pd.NA or (np.isscalar(v) and pd.isna(v)):
            return "none"
        if isinstance(v, (bool, np.bool_, str)):
            return str(v)
        v = round(float(v), 6) + 0.0
        return str(v)

    columns = sorted(df.columns)
    return columns, sorted("|".join(map(one, r)) for r in df[columns].astype(object).itertuples(index=False, name=None))


#: The longest chains rest on others in this list that are compared; the driver compares all.
@pytest.mark.parametrize("name", [
    "snp_qc", "fr_animal_yield", "fr_record_seq", "mendel_action", "merge_rows", "resolve_same_id", "ped_merge", "renumber", "cycle_guard", "colleau_apply", "a_matrix", "csr_build", "matrix_summary", "hap_vote", "ld_fill",
    "top2_margin", "seek_report", "scan_lines", "field_pos", "scan_ped_merge", "scan_finalreport", "scan_geno_sniff", "sink_geno_fr", "sink_ren_ped", "reports", "fn_clean", "fn_tokenise", "fn_whitespace", "fn_match",
])
def test_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(SQL[name]).df())


HENDERSON = [(1, None, None), (2, None, None), (3, 1, 2), (4, 1, None), (5, 4, 3), (6, 5, 2)]


@pytest.mark.parametrize("limit", [0, 100])
def test_henderson(spark, monkeypatch, limit):
    """By arrays and by joins."""
    monkeypatch.setattr(custom, "PEDIGREE_LIMIT", limit)
    ped = spark.createDataFrame(HENDERSON, "animal_id long, sire_id long, dam_id long").withColumn("byr", F.col("animal_id").cast("int")).withColumn("sex", F.lit(1))
    gen = custom.generations(ped)
    f = custom.settled(ped, gen)
    assert {r.animal_id: round(r.f, 6) for r in f.collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0.125, 6: 0.125}
    if limit:
        get = lambda name: {(r.i, r.j): r[2] for r in engine.run(spark, name, ped=ped, traced=gen, settled=f).collect()}
        a, inv = np.zeros((6, 6)), np.zeros((6, 6))
        for m, values in ((a, get("a_matrix")), (inv, get("a_inv"))):
            for (i, j), v in values.items():
                m[i - 1, j - 1] = m[j - 1, i - 1] = v
        assert np.allclose(a @ inv, np.eye(6), atol=1e-5)
        assert {r.animal_id: round(r.f, 6) for r in custom.inbreeding_tabular(ped, gen).collect()} == {r.animal_id: round(r.f, 6) for r in f.collect()}
    else:
        with pytest.raises(ValueError):
            custom.Pedigree(ped, gen)


def test_cycles(spark):
    """Two cycles tied by a link that lies on none, a self-parent, and animals behind and before."""
    rows = [(1, 2, 3), (2, 1, None), (3, 4, None), (4, 3, None), (5, 1, 6), (6, None, None), (7, 7, 5), (8, None, 7)]
    got = {tuple(r) for r in custom.cycle_guard(spark.createDataFrame(rows, "animal_id long, sire_id long, dam_id long")).collect()}
    assert got == {(1, None, 3), (2, None, None), (3, None, None), (4, None, None), (5, 1, 6), (6, None, None), (7, None, 5), (8, None, 7)}


@pytest.mark.parametrize("entries", [0, 100])
def test_conjugate_gradient(spark, entries):
    a = spark.createDataFrame([(1, 1, 4.0), (2, 1, 1.0), (2, 2, 3.0), (3, 3, 2.0)], "i long, j long, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 5.0)], "i long, y double")
    got = {r.i: r.x for r in custom.conjugate_gradient(a, b, entries=entries).collect()}
    assert [got[k] for k in (1, 2, 3)] == pytest.approx([1 / 11, 7 / 11, 2.5])


def test_exact_test_sums(spark):
    """Against direct enumeration."""
    want = []
    for n0, n1, n2 in [(10, 20, 10), (30, 1, 9), (25, 25, 0), (0, 40, 0), (17, 9, 14)]:
        n, rare = n0 + n1 + n2, 2 * min(n0, n2) + n1
        p = {k: math.exp(math.lgamma(n + 1) - math.lgamma((rare - k) / 2 + 1) - math.lgamma(k + 1) - math.lgamma(n - k - (rare - k) / 2 + 1) + k * math.log(2)) for k in range(rare % 2, rare + 1, 2)}
        want.append(round(sum(v for v in p.values() if v <= p[n1] * (1 + 1e-9)) / sum(p.values()), 6))
    geno = [(a, s, g) for s, c in enumerate([(10, 20, 10), (30, 1, 9), (25, 25, 0), (0, 40, 0), (17, 9, 14)]) for a, g in enumerate(sum(([g] * c[g] for g in range(3)), []))]
    got = engine.run(spark, "hwe_exact", geno=spark.createDataFrame(geno, "animal_id long, snp_idx int, g int")).orderBy("snp_idx").collect()
    assert [r.p for r in got] == pytest.approx(want, abs=2e-6)


def test_text_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("a1", [0, 1, None, 2]), ("b2", [2, None, None, 0])], "id string, geno array<int>")
    sinks.write_geno(wide, str(tmp_path / "g"))
    back = {r.id: r.geno for r in text.read_geno(spark, str(tmp_path / "g")).collect()}
    assert back == {"a1": [0, 1, None, 2], "b2": [2, None, None, 0]}
    again = {r.id: r.geno for r in text.to_wide(text.to_long(wide)).collect()}
    assert again == back
    (tmp_path / "ped.txt").write_text("# note\nid sire dam sex\nx1 0 d1 1\n\nx1 s1 d1 2 # later wins\n  y2  0  0  q\n")
    got = {tuple(r) for r in text.read_ped(spark, str(tmp_path / "ped.txt"), {"ANIMAL_ID": 1, "SRN": 2, "DAM": 3, "SEX": 4}, header=2).select("id", "sire", "dam", "sex").collect()}
    assert got == {("x1", "s1", "d1", 2), ("y2", None, None, None)}
    rows = spark.createDataFrame([(k, k // 2, k / 4) for k in range(10)], "i long, j long, v double")
    blocks = sinks.triplet_blocks(rows.coalesce(1), 10).collect()
    (tmp_path / "t").mkdir()
    for b in blocks:
        (tmp_path / "t" / f"{b.part}.bin").write_bytes(b.content)
    assert sorted(tuple(r) for r in text.read_triplets(spark, str(tmp_path / "t")).collect()) == [(k, k // 2, k / 4) for k in range(10)]
    with pytest.raises(ValueError):
        text.mismatches(text.read_geno(spark, str(tmp_path / "g"), n_snps=5), 5, stop=True)


def test_headers_go_by_place(spark, tmp_path):
    """Each file's first lines, not lines that look like them."""
    (tmp_path / "a.txt").write_text("h 1\nx 1\nh 1\n")
    (tmp_path / "b.txt").write_text("other 2\ny 2\n")
    assert sorted(r.line for r in text.lines(spark, str(tmp_path), header=1).collect()) == ["h 1", "x 1", "y 2"]


def test_sorted_map(spark):
    rows = [("b", 2, 5, 2), ("a", 1, 9, 1), ("x", 0, 1, 0), ("c", 2, 7, 3), ("z", 20, 1, 4)]
    markers = spark.createDataFrame(rows, "snp_id string, chr int, pos int, array_all int")
    assert {(r.snp_id, r.array_all, r.array_chr) for r in text.sorted_map(markers, 18).collect()} == {("a", 1, 1), ("b", 2, 1), ("c", 3, 2)}
    assert text.sorted_map(markers, stop=True).count() == 4
    with pytest.raises(ValueError):
        text.sorted_map(markers.withColumn("array_all", F.col("array_all") + 1), stop=True).count()


def test_functions(spark):
    df = spark.createDataFrame([("  a\t b  ", "2.5", 20240229, [0, 1, None, 2] * 5, "f(a[1](x)) b", "3.1400e5", "aabbaabb")], "s string, n string, d int, g array<int>, m string, z string, q string")
    r = df.select(
        X.compact(F.col("s")), X.to_int(F.col("n")), X.to_int(F.lit("99999999999")), X.to_int(F.lit("x")), X.julian_day(F.col("d")), X.unpack_genotypes(X.pack_genotypes(F.col("g")), 20), X.delete_first(F.col("n"), "."),
        X.match(F.col("m"), F.lit(2)), X.match(F.col("m"), F.lit(10)), X.match(F.col("m"), F.lit(1)), X.trim_zeros(F.col("z")), X.delete_all(F.col("q"), "ab"), X.parse(F.lit("a\\,b, c"), ","), X.split_string(F.lit(" a ,, b"), ","), X.julian_day(F.lit(0)),
    ).first()
    assert tuple(r) == ("a b", 3, 0, 0, 2460370, [0, 1, None, 2] * 5, "25", 10, 2, None, "3.14e5", "", ["a,b", "c"], ["a", "", "b"], 0)
    assert X.delimiter("tab") == "\t" and X.delimiter("#") == "#"


def test_parameters():
    got = parameters.parse("PEDFILE: 'ped.txt'  # file\nHEADER: 1\nDELIM: TAB\nNO_VAIABLES: 2\n1 ID\nSIRE: 3\nPOPQC:\nMAF: 0.05\nSEX_CONCORDENCE: yes\n")
    ped = got["PEDFILE"]
    assert (ped.file, ped.header, ped.delimiter, ped.fields) == ("ped.txt", 1, "TAB", {"ID": 1, "SIRE": 3})
    assert got["POPQC"].keys == {"MAF": ["0.05"], "SEX_CONCORDANCE": ["yes"]}


def test_stream(spark, tmp_path):
    rows = [(a, s, (a * s) % 3 if a % 4 else None) for a in range(12) for s in range(5)]
    spark.createDataFrame(rows, "animal_id long, snp_idx int, g int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("animal_id long, snp_idx int, g int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts.start_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.snp_idx: (r.n0, r.n1, r.n2, r.n) for r in counts.totals(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {s: tuple(sum(1 for _, t, g in rows if t == s and g == k) for k in range(3)) + (12,) for s in range(5)}
    assert got == want


def test_hap_windows_of_many_markers(spark):
    """Beyond 6,000 markers base and shifted windows have numbers of their own, and so have their panels; the last base window is short."""
    n = 6100
    small = {"width": 6, "shift": 3, "called_floor": 4}
    snp_map = spark.range(1, n + 1).select(F.col("id").cast("int").alias("snp_idx"))
    got = engine.run(spark, "hap_windows", small, snp_map=snp_map).collect()
    assert len(got) == len({r.window_id for r in got}) == -(-n // 6) + (n - 3) // 6
    assert {r.window_id for r in got if r.layer == 0} == set(range(-(-n // 6)))
    assert max(r.last_snp for r in got) == n
    geno = snp_map.crossJoin(spark.range(1, 4).withColumnRenamed("id", "animal_id")).select("animal_id", "snp_idx", F.lit(1).alias("g"))
    panel = engine.run(spark, "hap_panel", small, snp_map=snp_map, filled=geno).collect()
    assert len(panel) == len(got) and all(r.n == 3 for r in panel)


def test_windows_are_voted_in_two_passes(spark):
    """A fill of a base window changes the key of a shifted one, which then matches and fills."""
    full = [1, 2, 0, 1, 2, 0, 1, 1, 2, 2, 0, 1]
    rows = [(a, s + 1, g) for a in (1, 2) for s, g in enumerate(full)] + [(3, s + 1, None if s in (4, 7) else g) for s, g in enumerate(full)]
    rows += [(3 + k, s + 1, (g + 1 + (s + k) % 2) % 3) for k in (1, 2) for s, g in enumerate(full)]
    for r in list(rows):  # where the key's 0 for missing would match
        if r[0] == 2 and r[1] == 5:
            rows[rows.index(r)] = (2, 5, 0)
    filled = spark.createDataFrame(rows, "animal_id long, snp_idx int, g int")
    snp_map = spark.range(1, 13).select(F.col("id").cast("int").alias("snp_idx"))
    got = {(r.animal_id, r.snp_idx): r.g for r in engine.run(spark, "hap_vote", {"width": 6, "shift": 3, "called_floor": 3}, snp_map=snp_map, filled=filled).collect()}
    assert got[3, 5] == 0  # matched animal 2, whose call there is 0 like the key's
    assert set(got) <= {(3, 5), (3, 8)}


def _search(spark, ped, actions, checks, geno, name, **parameters):
    frames = {
        "ped": spark.createDataFrame(ped, "animal_id long, byr int, sex int, sire_id long, dam_id long"), "mendel_actions": spark.createDataFrame(actions, "animal_id long, action int"),
        "sex_checks": spark.createDataFrame(checks, "animal_id long, sex_qc int"), "geno": spark.createDataFrame(geno, "animal_id long, snp_idx int, g int"),
        "panel": spark.createDataFrame([(s, 0.5) for s in range(1, 31)], "snp_idx int, maf double"),
    }
    return engine.run(spark, name, {"compat_min": 8, "g_tol": "0.40e0", "recheck_min": 20, "animal_error": "0.30e0", **parameters}, **frames).collect()


def test_parents_are_sought_for_sex_conflicts(spark):
    """Children by action or sex conflict; candidates of confirmed sex only, of unknown sex in both slots, with unknown birth year at any age, or not in the pedigree."""
    ped = [(1, 2005, 1, 9, 8), (2, 2005, 2, 9, 8), (3, 2005, 1, 9, 8), (4, 2005, 1, 9, 8), (5, 2000, None, None, None), (6, 2000, 0, None, None), (7, None, 2, None, None), (10, 2000, 2, None, None)]
    actions, checks = [(1, 1), (2, 0), (3, 3), (4, 0)], [(1, 0), (2, 1), (3, 1), (4, 0), (5, 2), (6, 0), (7, 0), (10, -1), (11, 0)]
    geno = [(a, s, 1 + (s % 4 == 0)) for a in (*range(1, 8), 10, 11) for s in range(1, 31)]
    ask = lambda name, **p: _search(spark, ped, actions, checks, geno, name, swap_min="2e0", **p)
    assert {(r.animal_id, r.source) for r in ask("seek_children")} == {(1, "MEN"), (2, "SEX"), (3, "SEX")}
    assert {(r.cand, r.slot) for r in ask("cand_slot") if r.child == 2} == {(6, "sire"), (6, "dam"), (7, "sire"), (11, "sire"), (11, "dam")}
    assert {r.child: r.post for r in ask("seek_post_mendel")} == {1: "PASS", 2: "NA", 3: "NA"}


def test_one_new_parent_is_tested_alone(spark):
    """A duo after the search; the other slot keeps what was recorded."""
    ped = [(1, 2005, 1, 90, 91), (2, 2000, 2, None, None)]
    geno = [(1, s, s % 3) for s in range(1, 31)] + [(2, s, min(2, s % 3 + (s % 7 == 0 and s % 3 == 1))) for s in range(1, 31)]
    got = _search(spark, ped, [(1, 1)], [(1, 0), (2, 0)], geno, "seek_checks", g_tol="9e0")
    assert [(r.new_sire, r.new_dam, r.outcome, r.post) for r in got] == [(2, 91, "PARENT_UPDATE", "PASS")]


def test_swapped_samples(spark):
    """Mates who point at each other; one whose parents aren't recorded leads on to the next."""
    base = [s * 7 % 3 for s in range(1, 31)]
    flip = lambda at: [(g + 1) % 3 if s in at else g for s, g in enumerate(base)]
    rows = {1: base, 2: flip({3}), 5: [(g + 1) % 3 for g in base]}
    geno = [(a, s + 1, g) for a, row in rows.items() for s, g in enumerate(row)]
    ped = [(1, 2005, 1, 90, 91), (2, 2004, 1, 92, 93), (5, 2003, 2, None, None)]
    got = _search(spark, ped, [(1, 1)], [(1, 0), (2, 0), (5, 0)], geno, "seek_outcomes")
    assert [(r.child, r.mate, r.new_sire, r.new_dam, r.outcome) for r in got] == [(1, 2, 92, 93, "ID_SWAP")]
    # a mate without both parents leads on; here back to the child, whose own are recorded
    ped[1] = (2, 2004, 1, None, 93)
    got = _search(spark, ped, [(1, 1)], [(1, 1), (2, 1), (5, 1)], geno, "swap_prescan")
    assert [(r.child, r.mate, r.depth, r.found) for r in got] == [(1, 1, 2, "ID_SWAP")]
    # and where neither has both, nothing is swapped
    ped[0] = (1, 2005, 1, 90, None)
    got = _search(spark, ped, [(1, 1)], [(1, 1), (2, 1), (5, 1)], geno, "seek_outcomes")
    assert [(r.child, r.mate, r.outcome) for r in got] == [(1, None, "NOT_FOUND")]
