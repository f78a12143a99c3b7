"""Delimited and fixed-width text: line rules, markers, pedigrees, references, reports, genotype strings, triplets.

Every reader takes a path, or several, of one or many files and works line by line, so that files are split over tasks. A file's
header lines are told by their place in the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import delimiter, to_int, to_real

# Field names by synonym.
SYNONYMS = {
    "ANIMAL_ID": "ID", "ANIMAL_ARN": "ARN", "SRN": "SIRE", "SIRE_ID": "SIRE", "DRN": "DAM", "DAM_ID": "DAM", "BIRTH_DATE": "BDATE", "BIRHT_DATE": "BDATE", "BIRTH": "BDATE", "BIRTHDATE": "BDATE",
    "LOC": "LOCATION", "A1": "ALLELE1", "A2": "ALLELE2",
}
# Where a report's fields stand if nothing else is said.
REPORT_FIELDS = {"SAMPLE": 1, "SNP": 5, "ALLELE1": 11, "ALLELE2": 12, "R": 25, "GC": 27, "GT": 30, "SEP": 31}


def open_file(spark: SparkSession, path: str) -> bool:
    """Makes sure that a file is there, empty if it is new; whether it was there. Any store that Hadoop knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (there := store.exists(target)):
        store.create(target).close()
    return there


def raw_lines(spark: SparkSession, path: str, header: int = 0) -> DataFrame:
    """(value, file, ord): the lines of each file and their order in it, without its first `header` lines.

    Lines of a file's first block that come first in it are its header; they are found by one row a file.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    if header:
        first = rows.where("block = 0").groupBy("file").agg(F.min("at").alias("first"))
        rows = rows.join(first, "file").where(f"block > 0 or at >= first + {int(header)}")
    return rows.select("value", "file", (F.col("block") * F.lit(1 << 20) + F.col("at") % (1 << 33)).alias("ord"))


def _cleaned(value: Column) -> Column:
    return F.ltrim(F.regexp_replace(F.regexp_replace(value, "[\r\n\u0000]+$", ""), "#.*$", ""))


def lines(spark: SparkSession, path: str, header: int = 0) -> DataFrame:
    """(line, file, ord): lines without carriage returns and what follows a hash, trimmed on the left; blank ones are left out."""
    return raw_lines(spark, path, header).select(_cleaned(F.col("value")).alias("line"), "file", "ord").where("trim(line) <> ''")


def count_records(spark: SparkSession, path: str) -> int:
    """Lines that are neither blank nor a comment."""
    return spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").count()


def fields(line: Column, by: str) -> Column:
    """The fields of a line; runs of blanks and tabs count as one, other delimiters part empty fields."""
    return F.split(F.trim(F.regexp_replace(line, r"[ \t]+", " ")), " ") if by == " " else F.transform(F.split(line, f"\\Q{by}\\E"), lambda p: F.trim(p))


def field_position(line: Column, by: str, k: int) -> Column:
    """First and last place of the k-th field of a line from 1, (0, -1) if it has none; runs of delimiters that are blanks count as one."""
    one = r"[ \t]" if by in (" ", "\t") else "\\Q" + by + "\\E"
    before = f"^{one}*(?:[^{by if by not in (' ', chr(9)) else ' ' + chr(9)}]+{one}+){{{k - 1}}}" if by in (" ", "\t") else f"^(?:(?:(?!{one}).)*{one}){{{k - 1}}}"
    own = r"[^ \t]+" if by in (" ", "\t") else f"(?:(?!{one}).)*"
    whole, skipped = F.regexp_extract(line, f"({before}{own})", 1), F.regexp_extract(line, f"({before})(?:{own})", 1)
    start = F.char_length(skipped) + 1
    found = F.regexp_like(line, F.lit(f"{before}{own}"))
    return F.struct(F.when(found, start).otherwise(0).alias("start"), F.when(found, F.char_length(whole)).otherwise(-1).alias("end"))


def table(spark: SparkSession, path: str, columns: Mapping[str, int], by: str = " ", header: int = 0) -> DataFrame:
    """Named fields of a delimited text by their position from 1, with file and ord; `header` first lines of each file are left out.

    A field beyond a line's end is null. Names are upper-cased and synonyms folded.
    """
    split = lines(spark, path, header).select(fields(F.col("line"), delimiter(by)).alias("f"), "file", "ord")
    return split.select(*(F.try_element_at("f", F.lit(at)).alias(SYNONYMS.get(n.upper(), n.upper()).lower()) for n, at in columns.items()), "file", "ord")


# ---- markers

def read_map(spark: SparkSession, path: str, columns: Mapping[str, int], by: str = " ", header: int = 0, last_chr: int | None = None) -> DataFrame:
    """Markers (snp_id, chr, pos, ...): numbers parsed; with last_chr only chromosomes from 1 to it."""
    out = table(spark, path, columns, by, header).drop("file", "ord")
    for c in ("chr", "pos", "array_all", "array_chr"):
        if c in out.columns:
            out = out.withColumn(c, to_int(F.col(c)))
    return out if last_chr is None else out.where(F.col("chr").between(1, last_chr))


def sorted_map(markers: DataFrame, last_chr: int = 0, stop: bool = False) -> DataFrame:
    """Markers on a chromosome above 0 (and up to last_chr) with their ranks by chromosome and position: array_all over all,
    array_chr on the chromosome. Recorded ranks that differ are replaced, or with `stop` raise. One row a marker goes through one task."""
    rows = markers.where(F.col("chr") > 0) if last_chr <= 0 else markers.where(F.col("chr").between(1, last_chr))
    rank = "cast(row_number() over ({}order by chr, pos, snp_id) as int)"
    ranked = rows.withColumns({"_all": F.expr(rank.format("")), "_chr": F.expr(rank.format("partition by chr "))})
    if stop:
        wrong = [F.col(c) != F.col(n) for c, n in (("array_all", "_all"), ("array_chr", "_chr")) if c in rows.columns]
        for w in wrong:
            if not ranked.where(w).isEmpty():
                raise ValueError("recorded marker ranks aren't those by chromosome and position")
    return ranked.withColumns({"array_all": F.col("_all"), "array_chr": F.col("_chr")}).drop("_all", "_chr")


# ---- pedigrees

def _known(out: DataFrame) -> DataFrame:
    for c in set(out.columns) & {"id", "arn", "sire", "dam"}:
        out = out.withColumn(c, F.when(~F.col(c).isin("", "0"), F.col(c)))
    for c in set(out.columns) & {"sex", "bdate", "byr"}:
        out = out.withColumn(c, F.nullif(to_int(F.col(c)), F.lit(0)))
    return out


def read_ped(spark: SparkSession, path: str, columns: Mapping[str, int], by: str = " ", header: int = 0, key: str = "id") -> DataFrame:
    """Pedigree records, the last of a key winning (of the last file by name); 0 and blanks are unknown; a missing id takes the registration number."""
    out = _known(table(spark, path, columns, by, header))
    if {"id", "arn"} <= set(out.columns):
        out = out.withColumns({"id": F.coalesce("id", "arn"), "arn": F.coalesce("arn", "id")})
    kept = [c for c in out.columns if c not in ("file", "ord")]
    newest = F.max_by(F.struct(*kept), F.struct("file", "ord"))
    return out.where(f"{key} is not null").groupBy(F.col(key).alias("_key")).agg(newest.alias("r")).select("r.*")


def read_triples(spark: SparkSession, path: str, columns: Mapping[str, int], by: str = " ", header: int = 0) -> DataFrame:
    """All pedigree records (animal_id, sire_id, dam_id, byr, sex) as they stand, for ped_merge; records without an id are left out."""
    out = _known(table(spark, path, columns, by, header))
    take = lambda c: F.col(c) if c in out.columns else F.lit(None)
    born = take("byr") if "byr" in out.columns else F.floor(take("bdate") / 10000).cast("int")
    return out.where("id is not null").select(F.col("id").alias("animal_id"), take("sire").alias("sire_id"), take("dam").alias("dam_id"), born.cast("int").alias("byr"), take("sex").cast("int").alias("sex"))


def read_refs(spark: SparkSession, path: str, at: int = 1, sex_at: int | None = None, by: str = " ") -> DataFrame:
    """(id, sex) of a list of reference animals; a first line that names its columns is no record, unknown ids neither."""
    out = table(spark, path, {"ID": at} | ({"SEX": sex_at} if sex_at else {}), by)
    names = F.upper("id").isin("ID", "ANIMAL", "ANIMAL_ID", "REF", "REF_ID")
    sex = F.nullif(to_int(F.col("sex")), F.lit(0)) if sex_at else F.lit(None).cast("int")
    return out.where(~names & ~F.col("id").isin("", "0")).select("id", sex.alias("sex"))


# ---- reports

def read_report(spark: SparkSession, path: str, columns: Mapping[str, int] | None = None, by: str = "TAB", header: int = 10) -> DataFrame:
    """Records of genotyping reports: sample_key, snp_key, allele1_raw, allele2_raw, allele1, allele2, four metrics, file and ord.

    Positions that aren't given are the usual ones. Alleles are their first character in upper case: A and B as they are if
    `columns` calls them *_AB, else A and T against G and C. A metric that is missing or no number counts as 1.
    """
    names = {k.upper(): v for k, v in (columns or {}).items()}

    def place(*wanted: str) -> int:
        return next((v for k, v in names.items() if any(k == w or k.startswith(w + "_") for w in wanted)), 0)

    at = dict(REPORT_FIELDS)
    for field, wanted in {"SAMPLE": ("ANIMAL", "ID", "ARN", "SAMPLE"), "SNP": ("SNP",), "ALLELE1": ("ALLELE1",), "ALLELE2": ("ALLELE2",), "R": ("R",), "GC": ("GC",), "GT": ("GT",), "SEP": ("CLUSTER",)}.items():
        at[field] = place(*wanted) or at[field]
    ab = any(k in ("ALLELE1_AB", "ALLELE2_AB") for k in names)
    f = F.split(F.col("value"), f"\\Q{delimiter(by)}\\E")
    one = lambda k: F.trim(F.try_element_at(f, F.lit(at[k])))
    letter = lambda k: F.upper(F.substring(one(k), 1, 1))
    call = (lambda c: F.when(c.isin("A", "B"), c).otherwise("?")) if ab else (lambda c: F.when(c.isin("A", "T"), "A").when(c.isin("G", "C"), "B").otherwise("?"))
    metric = lambda k: F.coalesce(one(k).try_cast("double"), F.lit(1.0))
    rows = raw_lines(spark, path, header).where("trim(value) <> ''")
    return rows.select(
        one("SAMPLE").alias("sample_key"), one("SNP").alias("snp_key"), one("ALLELE1").alias("allele1_raw"), one("ALLELE2").alias("allele2_raw"), call(letter("ALLELE1")).alias("allele1"), call(letter("ALLELE2")).alias("allele2"),
        metric("R").alias("r_intensity"), metric("GC").alias("gc_score"), metric("GT").alias("gt_score"), metric("SEP").alias("cluster_sep"), "file", "ord",
    )


# ---- genotype strings

def _calls(digits: Column, kept: str = "012") -> Column:
    return F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: F.when(F.instr(F.lit(kept), c) > 0, c.cast("int")))


def read_geno(spark: SparkSession, path: str, by: str = " ", columns: Mapping[str, int] | None = None, n_snps: int | None = None, header: int = 0) -> DataFrame:
    """Genotype strings (id, geno array<int>): the last field of a line, or the named positions; anything but 0, 1, 2 is null.

    With n_snps short strings are filled with nulls and longer ones cut, and `length` is what they had.
    """
    f = fields(F.col("line"), delimiter(by))
    rows = lines(spark, path, header).select(f.alias("f")).where("size(f) > 1 and upper(element_at(f, -1)) <> 'GENO'")
    at = dict(columns or {"ID": 1, "GENO": -1})
    digits = F.element_at("f", at["GENO"])
    out = rows.select(F.element_at("f", at["ID"]).alias("id"), digits.alias("digits"))
    if not n_snps:
        return out.select("id", _calls(F.col("digits")).alias("geno"))
    padded = F.rpad("digits", n_snps, "9")
    return out.select("id", _calls(padded).alias("geno"), F.char_length("digits").alias("length"))


def mismatches(geno: DataFrame, n_snps: int, stop: bool = False) -> tuple[int, int]:
    """How many strings of read_geno(n_snps) were shorter and longer than that; with `stop` any raises."""
    short, long = geno.agg(F.count_if(F.col("length") < n_snps), F.count_if(F.col("length") > n_snps)).first()
    if stop and (short or long):
        raise ValueError(f"{short} genotype strings are shorter and {long} longer than {n_snps}")
    return short, long


def masked_geno(geno: DataFrame, snp_map: DataFrame, chromosomes: tuple[int, int] = (1, 18)) -> DataFrame:
    """(animal_id, snp_idx, g): the k-th digit belongs to the k-th marker, by address, on a chromosome of the mask; digits beyond are dropped."""
    passing = snp_map.where(F.col("chr").between(*chromosomes)).select("snp_idx").distinct()
    placed = passing.select("snp_idx", F.expr("cast(row_number() over (order by snp_idx) as int)").alias("k"))
    cells = geno.select(F.col("id").alias("animal_id"), F.posexplode("geno").alias("at", "g"))
    return cells.join(placed, F.col("at") + 1 == F.col("k")).select("animal_id", "snp_idx", "g")


def read_geno_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """(id, geno array<int>) of genotype files of any of three kinds, told by their first line: a header that names GENO (and an id
    column), fields of which the last is the genotypes, or an id and digits at fixed places. Any digit is kept as it is."""
    first = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").first()
    line = first.value if first else ""
    by = next((d for d in ("\t", ",", ";", "|") if d in line), " ")
    named = [t.strip().upper() for t in (line.split() if by == " " else line.split(by))]
    f = fields(F.col("line"), by)
    rows = lines(spark, path)
    if "GENO" in named:
        ids = [k for k, n in enumerate(named, 1) if n in ("ID", "ANIMAL_ID", "ANIMAL", "ARN", "ANIMAL_ARN")]
        at, g = (ids or [1])[0], named.index("GENO") + 1
        rows = rows.select(f.alias("f")).where(f"upper(try_element_at(f, {g})) <> 'GENO'")
        return rows.select(F.element_at("f", at).alias("id"), _calls(F.try_element_at("f", F.lit(g)), "0123456789").alias("geno"))
    if len(named) >= 2:
        return rows.select(f.alias("f")).select(F.element_at("f", 1).alias("id"), _calls(F.element_at("f", -1), "0123456789").alias("geno"))
    cut = line[:30].rfind(" ") + 1
    return rows.select(F.trim(F.substr("line", F.lit(1), F.lit(cut))).alias("id"), _calls(F.trim(F.substr("line", F.lit(cut + 1))), "0123456789").alias("geno"))


def to_long(wide: DataFrame) -> DataFrame:
    """(animal_id, snp_idx, g) from (id, geno)."""
    return wide.select(F.col("id").alias("animal_id"), F.posexplode("geno").alias("at", "g")).select("animal_id", (F.col("at") + 1).alias("snp_idx"), "g")


def to_wide(geno: DataFrame) -> DataFrame:
    """(id, geno) from (animal_id, snp_idx, g); markers in order, each animal with the same ones."""
    return geno.groupBy(F.col("animal_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("snp_idx", "g"))), lambda x: x["g"]).alias("geno"))


# ---- triplets

HEAD, ENTRY = "<4siiq", np.dtype([("i", "<i4"), ("j", "<i4"), ("v", "<f8")])


def parse_triplets(contents: DataFrame) -> DataFrame:
    """(i, j, v) of contents (content binary), each a triplet file: magic, version, order, number of entries, entries."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in (c.as_buffer() for c in batch.column(0)):
                magic, _, _, n = struct.unpack_from(HEAD, content)
                if magic not in (b"ATRP", b"AINV"):
                    raise ValueError(f"not a triplet file: {magic!r}")
                held = np.frombuffer(content, ENTRY, n, struct.calcsize(HEAD))
                yield pa.RecordBatch.from_arrays([pa.array(held["i"].astype("int64")), pa.array(held["j"].astype("int64")), pa.array(held["v"].astype("float64"))], ["i", "j", "v"])

    return contents.select("content").mapInArrow(parse, "i long, j long, v double")


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of triplet files."""
    return parse_triplets(spark.read.format("binaryFile").load(path))


number, real = to_int, to_real
