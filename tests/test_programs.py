"""The programs, from parameter files and text to what they write."""

import random

import numpy as np
import pytest

from genoloom import programs
from genoloom.sources import parameters

N_SNPS = 60


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two generations: six founders, twelve children; a map, a report, genotypes and parameter files."""
    at = tmp_path_factory.mktemp("programs")
    rng = random.Random(3)
    geno, ped = {}, []
    for k in range(6):
        geno[f"F{k}"] = [rng.choice([0, 1, 2]) for _ in range(N_SNPS)]
        ped.append((f"F{k}", "0", "0", 2 - k % 2, 20100101 + k))
    for k in range(12):
        s, d = f"F{2 * (k % 3)}", f"F{2 * ((k + 1) % 3) + 1}"
        give = lambda g: (g == 2) or (g == 1 and rng.random() < 0.5)
        geno[f"C{k:02d}"] = [int(give(a)) + int(give(b)) for a, b in zip(geno[s], geno[d], strict=True)]
        ped.append((f"C{k:02d}", s, d, 1 + k % 2, 20150101 + k))
    (at / "ped.txt").write_text("ID SIRE DAM SEX BDATE\n" + "".join(" ".join(map(str, r)) + "\n" for r in ped))
    (at / "map.txt").write_text("SNP_ID CHR POS\n" + "".join(f"S{k:03d} {1 + k % 18 if k < 48 else 20} {1000 * k + 7}\n" for k in range(N_SNPS)))
    order = sorted(range(N_SNPS), key=lambda k: (1 + k % 18 if k < 48 else 20, 1000 * k + 7))
    miss = {a: {k for k in range(N_SNPS) if (3 * i + k) % 19 == 0} for i, a in enumerate(geno)}
    shown = lambda a: "".join("9" if k in miss[a] else str(geno[a][k]) for k in order)
    (at / "geno.txt").write_text("".join(f"{a} {shown(a)}\n" for a in geno))
    pair = {0: ("A", "T"), 1: ("T", "C"), 2: ("G", "G")}
    records = [f"{a}\tS{k:03d}\t{pair[geno[a][k]][0]}\t{pair[geno[a][k]][1]}\t1.0\t{0.05 if k in miss[a] else 0.9}\tx\t0.5\n" for a in geno for k in range(N_SNPS)]
    (at / "LLrun1_FinalReport.txt").write_text("[Header]\nContent\n[Data]\n" + "".join(records))
    files = "PEDFILE: ped.txt\nHEADER: 1\nNO_VARIABLES: 5\nID: 1\nSIRE: 2\nDAM: 3\nSEX: 4\nBDATE: 5\nMAPFILE: map.txt\nHEADER: 1\nNO_VARIABLES: 3\nSNP_ID: 1\nCHR: 2\nPOS: 3\n"
    return at, files, geno, shown, ped


def lines(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_report_to_genotypes(spark, folder):
    at, files, geno, shown, _ = folder
    fields = "ANIMAL_ID: 1\nSNP_ID: 2\nALLELE1_TOP: 3\nALLELE2_TOP: 4\nR_INTENSITY: 5\nGC_SCORE: 6\nGT_SCORE: 7\nCLUSTER_SEP: 8\n"
    text = files + f"FRFILE: LLrun1_FinalReport.txt\nDELIM: TAB\nHEADER: 3\nNO_VARIABLES: 8\n{fields}FRQC:\nANIMAL_CR: 0.5\nOUTPUT: out\nNO_VARIABLES: 3\nID: 8\nSEX: 2\nGENO: 0\n"
    got = programs.read_fr(spark, text, str(at), str(at / "fr"))
    written = {line[:8].strip(): line.split()[-1] for line in lines(at / "fr" / "GENO_LLrun1.txt")}
    assert written == {a: shown(a) for a in geno}
    assert all(r.status == "PASS" and r.n_records == N_SNPS for r in got["yields"].collect())


def test_population_quality_control(spark, folder):
    at, files, geno, shown, _ = folder
    text = files + "GENOFILE: geno.txt\nPOPQC:\nMAF: 0.05\nSNP_CR: 0.5\n"
    got = programs.pop_qc(spark, text, str(at), str(at / "qc"))
    good = [r.snp_idx for r in got["snp_quality"].where("status = 0 and autosome = 1").orderBy("snp_idx").collect()]
    assert 20 < len(good) <= 48
    cleaned = {line.split()[0]: line.split()[-1] for line in lines(at / "qc" / "geno_cleaned.txt")}
    assert cleaned == {a: "".join(shown(a)[k - 1] for k in good) for a in geno}
    assert any("SNP QC" in line for line in lines(at / "qc" / "report_snp_quality.txt"))


def test_pedigree_relationships(spark, folder):
    at, files, _, _, ped = folder
    got = programs.rel_ped(spark, files.split("MAPFILE")[0] + "A: yes\n", str(at), str(at / "ped_out"))
    rows = lines(at / "ped_out" / "renumbered_ped.txt")
    assert len(rows) == len(ped) and [int(r.split()[0]) for r in rows] == list(range(1, len(ped) + 1))
    n = len(ped)
    dense = {}
    for name in ("a", "ainv"):
        m = np.zeros((n, n))
        for r in got[name].collect():
            m[r.i - 1, r.j - 1] = m[r.j - 1, r.i - 1] = r.v
        dense[name] = m
    assert np.allclose(dense["a"] @ dense["ainv"], np.eye(n), atol=1e-8)
    assert len(lines(at / "ped_out" / "ainv.txt")) == got["ainv"].count()
    (at / "refs.txt").write_text("ID\nC00\nF5\n")
    few = programs.rel_ped(spark, files.split("MAPFILE")[0] + "REFFILE: refs.txt\n", str(at), str(at / "ped_refs"))
    assert few["renumbered"].count() == 4  # C00, its parents, and F5


def test_genomic_relationships(spark, folder):
    at, _, geno, shown, _ = folder
    got = programs.rel_geno(spark, "GENOFILE: geno.txt\nCOMPUTE_GINV: yes\n", str(at), str(at / "g"))
    n = len(geno)
    m = {name: np.zeros((n, n)) for name in ("g", "ginv")}
    for name in m:
        for r in got[name].collect():
            m[name][r.i - 1, r.j - 1] = m[name][r.j - 1, r.i - 1] = r.g
    assert np.allclose(m["g"] @ m["ginv"], np.eye(n), atol=1e-6)
    x = np.array([[int(c) for c in shown(a)] for a in sorted(geno)], float)
    x[x == 9] = np.nan
    p = np.nanmean(x, axis=0) / 2
    z = np.nan_to_num(x - 2 * p)
    k = (~np.isnan(x) * 2 * p * (1 - p)).sum(axis=1)
    assert np.allclose(m["g"], 0.95 * (z @ z.T) / np.sqrt(np.outer(k, k)) + 0.05 * np.eye(n), atol=1e-9)
    assert len(lines(at / "g" / "g.txt")) == n * (n + 1) // 2 and len(lines(at / "g" / "gdiag.txt")) == n


def test_imputation(spark, folder):
    at, files, geno, shown, _ = folder
    text = files + "CANDIDATE_GENOFILE: geno.txt\nHAPLOTYPE:\nWINDOW: 12 14\nSHIFT: 4\nLD:\nWINDOW: 2\n"
    got = programs.impute(spark, text, str(at), str(at / "imputed"))
    written = {line.split()[0]: line.split()[1] for line in lines(at / "imputed" / "imputed.geno")}
    assert set(written) == set(geno) and all(len(v) == N_SNPS and "9" not in v for v in written.values())
    assert all(w == c for a in geno for w, c in zip(written[a], shown(a), strict=True) if c != "9")
    assert {r.filled_by for r in got["imputed"].select("filled_by").distinct().collect()} >= {"called", "neighbours"}


def test_missing_sections(spark, tmp_path):
    with pytest.raises(ValueError, match="GENOFILE"):
        programs.rel_geno(spark, "MAPFILE: x\n", str(tmp_path), str(tmp_path))
    assert set(programs.PROGRAMS) == {"readfr", "popqc", "relped", "relgeno", "phimpute"}
    assert parameters.parse("A: 1\n")[""].keys == {"A": ["1"]}
