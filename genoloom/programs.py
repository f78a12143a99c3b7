"""The five programs, driven by parameter files: report to genotypes, population quality control, pedigree and genomic relationships, imputation.

Each takes the text of a parameter file and the folder that its paths are relative to, and writes below `out`. It returns the frames
that it wrote, by name. Every step is a relation of plans.engine over the frames of the step before.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import custom, identity, imputation, markers, matrices, mendel, parentage, pedigree, reports  # noqa: F401
from .plans import engine
from .plans.scratch import stored
from .sources import parameters, sinks, text

# Parameters of relations by the keys of parameter files.
_KEYS = {
    "FRQC": {"GC_SCORE": "gc_min", "GT_SCORE": "gt_min", "CLUSTER_SEP": "sep_min", "ANIMAL_CR": "animal_cr"},
    "POPQC": {"MAF": "min_maf", "SNP_CR": "snp_cr", "ANIMAL_CR": "low_cr", "HWE_THRESHOLD": "hwe_alpha", "HWE_MIN_N": "hwe_min_n", "HWE_MIN_MAC": "hwe_min_mac", "SEX_CONCORDANCE": "female_f", "MENDEL_SNP": "snp_error",
        "MENDEL_ANIMAL": "animal_error", "PARENT_SEEK": "compat", "PARENT_SEEK_G_TOL": "g_tol", "ID_MERGE_SAMPLE_FRACTION": "id_fraction", "ID_MERGE_CONFIRM_MATCH_THRESHOLD": "confirm_rate", "ID_SWAP_COMPAT_MIN": "swap_min",
        "ID_SWAP_MAX_DEPTH": "swap_depth", "MULTI_RESOLVED_ACTION": "multi_action"},
    "QC": {"SAMPLE_MISS_MAX": "max_sample_missing", "SNP_MISS_MAX": "max_snp_missing", "MIN_MAF": "min_snp_maf", "MAF": "min_snp_maf"},
    "LD": {"WINDOW": "ld_window"},
    "G_OPTIONS": {"WEIGHT": "weight"},
}


def _given(config: Mapping[str, parameters.Section]) -> dict[str, str]:
    """Parameters of relations that a file sets; a key may stand in its section or before any."""
    out = {}
    for section, keys in _KEYS.items():
        for held in (config.get("", parameters.Section()), config.get(section, parameters.Section())):
            for key, name in keys.items():
                if held.keys.get(key):
                    value = held.keys[key][-1]
                    out[name] = value if value.lstrip("+-").isdigit() else f"{float(value)!r}e0" if "e" not in value.lower() else value
    if r := config.get("FRQC", parameters.Section()).keys.get("R_INTENSITY"):
        out |= {"r_min": f"{float(r[0])}e0", "r_max": f"{float(r[-1])}e0"}
    return out


def _path(folder: str, section: parameters.Section) -> str:
    if not section.file:
        raise ValueError("a section names no file")
    return section.file if "://" in section.file or section.file.startswith("/") else f"{folder.rstrip('/')}/{section.file}"


def _need(config: Mapping[str, parameters.Section], *names: str) -> parameters.Section:
    for n in names:
        if n in config:
            return config[n]
    raise ValueError(f"the parameter file has no section {' or '.join(names)}")


def _markers(spark: SparkSession, config: Mapping[str, parameters.Section], folder: str) -> DataFrame:
    """snp_idx (the address, or the rank where none is recorded), snp_id, chr, pos and alleles."""
    s = _need(config, "MAPFILE")
    rows = text.read_map(spark, _path(folder, s), s.fields, s.delimiter, s.header)
    if "array_all" not in rows.columns:
        rows = text.sorted_map(rows)
    return stored(rows.withColumn("snp_idx", F.col("array_all")), "markers")


def _ped(spark: SparkSession, config: Mapping[str, parameters.Section], folder: str) -> DataFrame:
    """Pedigree records with ids as they are; byr from the birth date."""
    s = _need(config, "PEDFILE", "DATAFILE")
    rows = text.read_ped(spark, _path(folder, s), s.fields, s.delimiter, s.header)
    for c, kind in (("sire", "string"), ("dam", "string"), ("sex", "int"), ("bdate", "int"), ("breed", "string"), ("arn", "string"), ("location", "string")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    born = F.col("byr") if "byr" in rows.columns else F.floor(F.col("bdate") / 10000).cast("int")
    return stored(rows.withColumn("byr", born), "ped")


def _numbered(ids: DataFrame) -> DataFrame:
    """(name, animal_id): a number for each distinct name, in their order. One row an animal goes through one task."""
    return stored(ids.select("name").where("name is not null").distinct().select("name", F.expr("cast(row_number() over (order by name) as bigint)").alias("animal_id")), "numbers")


def _numbers(ped: DataFrame, *more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers of all ids, and the pedigree (animal_id, sire_id, dam_id, sex, byr, breed) in them."""
    names = ped.select(F.col("id").alias("name")).union(ped.select("sire")).union(ped.select("dam"))
    for m in more:
        names = names.union(m.select("id"))
    numbers = _numbered(names)
    out = ped.join(numbers.withColumnRenamed("name", "id"), "id")
    for c in ("sire", "dam"):
        out = out.join(numbers.select(F.col("name").alias(c), F.col("animal_id").alias(f"{c}_id")), c, "left")
    return numbers, stored(out.select("animal_id", "sire_id", "dam_id", "sex", "byr", "breed", "id", "arn", "sire", "dam", "bdate", "location"), "ped_numbered")


def _layout(config: Mapping[str, parameters.Section], default: Mapping[str, int | None]) -> Mapping[str, int | None]:
    s = config.get("OUTPUT")
    return {k: (w or None) for k, w in s.fields.items()} if s and s.fields else default


_OUT = {"ID": 20, "BREED": 5, "SIRE": 20, "DAM": 20, "SEX": 1, "BDATE": 8, "LOCATION": 10, "GENO": None}


def read_fr(spark: SparkSession, text_of: str, folder: str, out: str) -> dict[str, DataFrame]:
    """A genotyping report to genotypes: records are judged and coded, samples looked up in the pedigree (by id, then by registration
    number, else kept), placed by their marker's address, and written if enough of the map is called."""
    config = parameters.parse(text_of)
    given = _given(config)
    source = _need(config, "FRFILE")
    fr = text.read_report(spark, _path(folder, source), source.fields, source.delimiter if source.delimiter != "SPACE" else "TAB", source.header)
    markers, ped = _markers(spark, config, folder), _ped(spark, config, folder)
    calls = stored(engine.run(spark, "fr_calls", given, fr=fr), "calls")
    placed = calls.join(markers.select(F.col("snp_id").alias("snp_key"), "snp_idx", "chr"), "snp_key")
    seen = placed.groupBy("sample_key", "snp_idx").agg(F.max_by("g", F.struct("file", "ord")).alias("g"))
    n = markers.count()
    by_id = ped.select(F.col("id").alias("sample_key"), *ped.columns)
    by_arn = ped.select(F.col("arn").alias("sample_key"), *ped.columns).dropDuplicates(["sample_key"]).join(by_id.select("sample_key"), "sample_key", "left_anti")
    peds = by_id.unionByName(by_arn)
    samples = calls.select("sample_key").distinct().join(peds, "sample_key", "left").withColumn("id", F.coalesce("id", "sample_key"))
    cells = stored(samples.select("sample_key").crossJoin(F.broadcast(markers.select("snp_idx"))).join(seen, ["sample_key", "snp_idx"], "left").withColumnRenamed("snp_idx", "place") if n <= 1_000_000 else seen.withColumnRenamed("snp_idx", "place"), "cells")
    least = float(str(given.get("animal_cr", engine.DEFAULTS["animal_cr"])))
    yields = stored(engine.run(spark, "fr_animal_yield", given, fr=fr), "yields")
    lines = sinks.from_report(cells, samples, least, _layout(config, _OUT))
    sinks.put(lines, f"{out}/{sinks.report_name(source.file or 'report')}")
    return {"yields": yields, "cells": cells}


def _genotypes(spark: SparkSession, config: Mapping[str, parameters.Section], folder: str, *names: str) -> DataFrame:
    s = _need(config, *names)
    at = {k: s.fields[k] for k in s.fields}
    columns = {"ID": next((v for k, v in at.items() if k in ("ID", "ANIMAL_ID", "ARN", "ANIMAL_ARN")), 1), "GENO": at.get("GENO", -1)}
    return text.read_geno(spark, _path(folder, s), s.delimiter, columns, header=s.header)


def pop_qc(spark: SparkSession, text_of: str, folder: str, out: str) -> dict[str, DataFrame]:
    """Population quality control: marker statistics, sex checks, duplicate samples, Mendelian tests, parentage search, and the cleaned genotypes.

    Steps see what the ones before decided, but marker statistics are those of the input, and the pedigree never changes.
    """
    config = parameters.parse(text_of)
    given = _given(config)
    markers, records, wide = _markers(spark, config, folder), _ped(spark, config, folder), _genotypes(spark, config, folder, "GENOFILE")
    numbers, ped = _numbers(records, wide)
    geno = stored(text.masked_geno(wide, markers, (0, 99)).withColumnRenamed("animal_id", "name").join(numbers, "name").select("animal_id", "snp_idx", "g"), "geno")
    frames = {"geno": geno, "snp_map": markers, "ped": ped.select("animal_id", "sire_id", "dam_id", "sex", "byr", "breed")}
    steps = {}
    for name in ("snp_quality", "sex_checks", "panel", "id_panel", "mendel_actions", "merges", "merge_identical", "finalize_deferred", "seek_checks", "seek_normalize", "mendel_recheck", "seek_report", "parent_seek_cube"):
        steps[name] = stored(engine.run(spark, name, given, **frames, **{k: v for k, v in steps.items() if k in engine.RELATIONS}), name)
    deleted = [steps["mendel_actions"].where("action = 2").select("animal_id"), steps["merge_identical"].select(F.col("drop_row").alias("animal_id")), steps["mendel_recheck"].where("action = 2").select("animal_id"),
        steps["seek_normalize"].where("action = 2").select(F.col("child").alias("animal_id"))]
    actions = deleted[0]
    for d in deleted[1:]:
        actions = actions.union(d)
    actions = actions.distinct().withColumn("action", F.lit(2))
    renamed = steps["seek_normalize"].select(F.col("child").alias("animal_id"), "final_id")
    peds = ped.join(renamed, "animal_id", "left").join(numbers.select(F.col("animal_id").alias("final_id"), F.col("name").alias("final_name")), "final_id", "left")
    peds = numbers.join(peds.drop("final_id"), "animal_id", "left").withColumn("shown", F.coalesce("final_name", "name")).drop("id")
    good = steps["snp_quality"].where("status = 0 and autosome = 1").select("snp_idx")
    layout = _layout(config, _OUT)
    lines = sinks.cleaned(geno, good, actions, peds, {("shown" if k.upper() in ("ID", "ANIMAL_ID") else k): w for k, w in layout.items()})
    stem = (_need(config, "GENOFILE").file or "geno").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    sinks.put(lines, f"{out}/{stem}_cleaned.txt")
    for title, rows, label in (("SNP QC", "snp_quality", "status"), ("Sex check", "sex_checks", "sex_qc"), ("Mendel", "mendel_actions", "action"), ("Parent seek", "seek_checks", "outcome")):
        sinks.put(sinks.report_lines(steps[rows].groupBy(F.col(label).alias("label")).count().withColumnRenamed("count", "n"), title), f"{out}/report_{rows}.txt")
    return steps | {"actions": actions, "numbers": numbers}


def rel_ped(spark: SparkSession, text_of: str, folder: str, out: str) -> dict[str, DataFrame]:
    """Pedigree relationships: records merged, cycles cleared, generations traced from the reference animals (all if none are
    given), renumbered, inbreeding, the relationship matrix (OUTPUT key A) and its inverse."""
    config = parameters.parse(text_of)
    s = _need(config, "PEDFILE", "DATAFILE")
    rows = text.read_triples(spark, _path(folder, s), s.fields, s.delimiter, s.header)
    merged = stored(engine.run(spark, "ped_merge", ped=rows), "merged")
    names = _numbered(merged.select(F.col("id").alias("name")))
    ped = merged.join(names.withColumnRenamed("name", "id"), "id")
    for c in ("sire", "dam"):
        ped = ped.join(names.select(F.col("name").alias(c), F.col("animal_id").alias(f"{c}_id")), c, "left")
    ped = stored(ped.select("animal_id", "sire_id", "dam_id", "sex", "byr", F.col("id").alias("name")), "ped")
    clean = custom.cycle_guard(engine.run(spark, "ped_sanitize", ped=ped))
    ped = stored(ped.drop("sire_id", "dam_id").join(clean, "animal_id"), "guarded")
    if "REFFILE" in config:
        r = config["REFFILE"]
        refs = text.read_refs(spark, _path(folder, r), r.fields.get("ID", 1), r.fields.get("SEX"), r.delimiter)
        seeds = names.join(refs.select(F.col("id").alias("name")).distinct(), "name").select("animal_id")
        wanted = frontier = stored(seeds, "seeds")
        parents = ped.select("animal_id", F.explode(F.array("sire_id", "dam_id")).alias("parent")).where("parent is not null")
        while not frontier.isEmpty():  # ancestors of the reference animals
            frontier = stored(frontier.join(parents, "animal_id").select(F.col("parent").alias("animal_id")).distinct().join(wanted, "animal_id", "left_anti"), "frontier")
            wanted = stored(wanted.union(frontier), "wanted")
        ped = stored(ped.join(wanted, "animal_id", "left_semi"), "traced_ped")
    frames = {"ped": ped, "traced": stored(custom.generations(ped), "gen")}
    frames["settled"] = stored(custom.settled(ped, frames["traced"]), "f")
    numbered = stored(engine.run(spark, "renumber", **frames), "renumbered")
    keys = {k for held in config.values() for k in held.keys}
    label = names.select("animal_id", "name")
    shown = numbered.join(frames["settled"], "animal_id").join(ped.select("animal_id", "sire_id", "dam_id"), "animal_id")
    for c in ("animal_id", "sire_id", "dam_id"):
        shown = shown.join(label.select(F.col("animal_id").alias(c), F.col("name").alias(f"{c}_name")), c, "left")
    shown = shown.select("nid", "sire_nid", "dam_nid", "sex", "byr", "gen", F.lit(1).alias("obs"), F.round("f", 6).alias("f"), *(F.col(f"{c}_name").alias(c) for c in ("animal_id", "sire_id", "dam_id")))
    sinks.put(sinks.renumbered_ped(shown).orderBy("nid"), f"{out}/renumbered_ped.txt")
    by = numbered.select("animal_id", "nid")
    n, done = numbered.count(), {"renumbered": numbered, "inbreeding": frames["settled"]}
    for name, relation, value, magic in (("ainv", "a_inv", "v", b"AINV"), *((("a", "a_columns", "a", b"ATRP"),) if "A" in keys or "AMATRIX" in keys else ())):
        entries = engine.run(spark, relation, **frames)
        entries = entries.join(by.toDF("i", "ni"), "i").join(by.toDF("j", "nj"), "j").select(F.greatest("ni", "nj").alias("i"), F.least("ni", "nj").alias("j"), F.col(value).alias("v"))
        done[name] = stored(entries, name)
        sinks.triplet_blocks(done[name], n, magic).write.parquet(f"{out}/{name}_triplets")
        sinks.put(sinks.triplet_lines(done[name], numbered.join(label, "animal_id").select("nid", F.col("name").alias("id"))), f"{out}/{name}.txt")
    return done


def rel_geno(spark: SparkSession, text_of: str, folder: str, out: str) -> dict[str, DataFrame]:
    """The genomic relationship matrix of a genotype file, its diagonal, and its inverse where COMPUTE_GINV asks for it."""
    config = parameters.parse(text_of)
    given = _given(config)
    wide = text.read_geno_sniffed(spark, _path(folder, _need(config, "GENOFILE")))
    numbers = _numbered(wide.select(F.col("id").alias("name")))
    geno = stored(text.to_long(wide).withColumnRenamed("animal_id", "name").join(numbers, "name").select("animal_id", "snp_idx", F.when(F.col("g") <= 2, F.col("g")).alias("g")), "geno")
    grm = stored(engine.run(spark, "grm", given, geno=geno), "grm")
    wanted = any(parameters.to_logical(v[0]) for held in config.values() for k, v in held.keys.items() if k == "COMPUTE_GINV" and v)
    a, b = numbers.select(F.col("animal_id").alias("i"), F.col("name").alias("a")), numbers.select(F.col("animal_id").alias("j"), F.col("name").alias("b"))
    done = {"g": grm} | ({"ginv": stored(custom.inverse(grm).withColumnRenamed("v", "g"), "ginv")} if wanted else {})
    for name, m in done.items():
        sinks.put(_named(m, a, b), f"{out}/{name}.txt")
    own, less = sinks.diagonal_lines(grm.where("i = j").join(a, "i").select(F.col("a").alias("i"), F.col("a").alias("j"), "g"))
    sinks.put(own, f"{out}/gdiag.txt")
    sinks.put(less, f"{out}/gib.txt")
    sinks.put(sinks.report_lines(engine.run(spark, "matrix_summary", given, grm=grm).select(F.col("part").alias("label"), "n"), "G matrix"), f"{out}/report_g.txt")
    return done


def _named(m: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of a matrix with the names of its rows and columns."""
    named = m.where("i <= j").join(a, "i").join(b, "j")
    return named.select(F.format_string("%s %s %24.16E", "a", "b", F.col("g").cast("double")).alias("value"))


def tune(spark: SparkSession, given: Mapping[str, object], windows: list[int], shifts: list[int], **frames: DataFrame) -> tuple[list[tuple[int, int, int, int]], tuple[int, int]]:
    """(width, shift, checked, filled) of every pair of candidates, and the pair that fills most, then at the better rate, then the first."""
    rows = []
    for w in windows:
        for s in shifts:
            pair = (w, max(0, min(s, w // 2)))
            effect = engine.run(spark, "hap_effect", {**given, "width": pair[0], "shift": pair[1]}, **frames).first()
            rows.append((*pair, effect.checked, effect.filled))
    best = max(range(len(rows)), key=lambda k: (rows[k][3], rows[k][3] / max(1, rows[k][2]), -k))
    return rows, rows[best][:2]


def impute(spark: SparkSession, text_of: str, folder: str, out: str) -> dict[str, DataFrame]:
    """Imputation: quality filters (where QC is on), trios, haplotype windows of tuned widths, neighbours, and the filled genotypes."""
    config = parameters.parse(text_of)
    given = _given(config)
    markers = text.sorted_map(_markers(spark, config, folder)).withColumn("snp_idx", F.col("array_all"))
    wide = _genotypes(spark, config, folder, "CANDIDATE_GENOFILE", "GENOFILE")
    records = _ped(spark, config, folder)
    numbers, ped = _numbers(records, wide)
    geno = stored(text.to_long(wide).withColumnRenamed("animal_id", "name").join(numbers, "name").select("animal_id", "snp_idx", "g"), "geno")
    qc = config.get("QC", parameters.Section())
    if parameters.to_logical((qc.keys.get("ENABLE") or ["no"])[0]):
        kept = [stored(engine.run(spark, n, given, geno=geno), n) for n in ("sample_missing_filter", "snp_missing_maf_filter")]
        animals = numbers.join(geno.select("animal_id").distinct(), "animal_id", "left_semi")
        sinks.put(sinks.removed(animals, kept[0].join(numbers, "animal_id"), "name"), f"{out}/qc_removed_samples.txt")
        sinks.put(sinks.removed(markers, kept[1].join(markers.select("snp_idx", "snp_id"), "snp_idx"), "snp_id"), f"{out}/qc_removed_snps.txt")
        geno = geno.join(kept[0].select("animal_id"), "animal_id", "left_semi").join(kept[1].select("snp_idx"), "snp_idx", "left_semi")
        ranks = text.sorted_map(markers.join(kept[1].select("snp_idx"), "snp_idx", "left_semi")).select("snp_idx", F.col("array_all").alias("rank"), "snp_id", "chr", "pos")
        geno = stored(geno.join(ranks.select("snp_idx", "rank"), "snp_idx").select("animal_id", F.col("rank").alias("snp_idx"), "g"), "qc_geno")
        markers = ranks.drop("snp_idx").withColumnRenamed("rank", "snp_idx")
    frames = {"geno": geno, "snp_map": stored(markers.select("snp_idx", "snp_id", "chr", "pos"), "used_map"), "ped": ped.select("animal_id", "sire_id", "dam_id", "sex", "byr", "breed")}
    frames["filled"] = stored(engine.run(spark, "filled", given, **frames), "filled")
    hap = config.get("HAPLOTYPE", parameters.Section()).keys
    many = lambda key, default: [int(v) for v in hap.get(key, default)]
    _, best = tune(spark, given, many("WINDOW", [24, 28, 32]), many("SHIFT", [8, 10, 12]), **frames)
    done = stored(engine.run(spark, "imputed", {**given, "width": best[0], "shift": best[1]}, **frames), "imputed")
    sinks.write_geno(text.to_wide(done.select("animal_id", "snp_idx", "g")).withColumnRenamed("id", "animal_id").join(numbers, "animal_id").select(F.col("name").alias("id"), "geno"), f"{out}/imputed.geno")
    return {"imputed": done, "numbers": numbers}


PROGRAMS = {"readfr": read_fr, "popqc": pop_qc, "relped": rel_ped, "relgeno": rel_geno, "phimpute": impute}


def hap_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of window widths and shifts over the driver's tables."""
    frames = {n: stored(engine.over_tables(spark, sf_dir, n), n) for n in ("snp_map", "filled")}
    rows, best = tune(spark, engine.FIXTURE, [4, 6, 8], [0, 2, 3], **frames)
    return spark.createDataFrame([(*r, r[:2] == best) for r in rows], "width int, shift int, checked long, filled long, best boolean")


def hap_tune_oracle() -> str:
    grid = [(w, s) for w in (4, 6, 8) for s in (0, 2, 3)]
    grid = [(w, max(0, min(s, w // 2)), k) for k, (w, s) in enumerate(grid)]
    each = " union all ".join(f"select {w} as width, {s} as shift, {k} as k, checked, filled from ({engine.oracle('hap_effect', {'width': w, 'shift': s})}) e{k}" for w, s, k in grid)
    return f"select width, shift, checked, filled, row_number() over (order by filled desc, filled * 1.0e0 / greatest(1, checked) desc, k) = 1 as best from ({each}) g"
