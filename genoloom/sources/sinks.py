"""What programs write: genotype files, pedigrees, triplets, relationship matrices, removed lists and reports, as lines or binary blocks.

Each sink is a DataFrame of lines (column value), or of whole binary files (part, content) of bounded size; `put` writes lines.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DELIMITERS
from .text import ENTRY, HEAD

#: Entries of one binary block: 1 MB, as Parquet's readers and writers hold a hundred rows and more at once.
BLOCK_ENTRIES = 1 << 16


def put(df: DataFrame, path: str, compression: str = "none") -> None:
    """Writes the lines (value) of df; files are as many as its partitions."""
    df.select("value").write.option("compression", compression).text(path)


def fixed(c: Column, width: int | None) -> Column:
    """A field padded or cut to its width; null is empty, and without a width nothing is padded."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.rpad(text, width, " ") if width else text


def digits(geno: Column) -> Column:
    """Genotypes as digits, 9 for missing."""
    return F.concat_ws("", F.transform(geno, lambda g: F.coalesce(g, F.lit(9)).cast("string")))


def report_name(report: str, taken: int = 0) -> str:
    """The name of the genotype file of a report: its first six characters, and a number if that is taken."""
    stem = re.sub(r".*/", "", report)[:6]
    return f"GENO_{stem}{f'_{taken}' if taken else ''}.txt"


def geno_lines(wide: DataFrame, layout: Mapping[str, int | None], by: str = "SPACE") -> DataFrame:
    """One line an animal: the fields of layout (name -> width) in their order; `geno` is written as digits."""
    cells = [digits(F.col("geno")) if n.lower() == "geno" else fixed(F.col(n.lower()), w) for n, w in layout.items()]
    return wide.select(F.concat_ws(DELIMITERS.get(by.upper(), by), *cells).alias("value"))


def write_geno(wide: DataFrame, path: str, widths: Mapping[str, int] | None = None) -> None:
    """One line an animal: all other columns, padded or cut to their widths, then the genotypes; an unknown field is 0."""
    others = [c for c in wide.columns if c != "geno"]
    known = wide.select(*(F.coalesce(F.col(c).cast("string"), F.lit("0")).alias(c) for c in others), "geno")
    put(geno_lines(known, {c: (widths or {}).get(c) for c in others} | {"geno": None}), path)


def from_report(calls: DataFrame, peds: DataFrame, least: float, layout: Mapping[str, int | None], by: str = "SPACE") -> DataFrame:
    """Lines of the animals of a report whose share of valid calls is `least` or more: calls (sample_key, place, g), peds (sample_key, ...)."""
    wide = calls.groupBy("sample_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "g"))), lambda x: x["g"]).alias("geno"), F.count("g").alias("valid"), F.count("*").alias("n"))
    kept = wide.where(F.col("valid") / F.col("n") >= least) if least > 0 else wide
    return geno_lines(kept.join(peds, "sample_key", "left"), layout, by)


def cleaned(geno: DataFrame, snps: DataFrame, actions: DataFrame, peds: DataFrame, layout: Mapping[str, int | None], by: str = "SPACE") -> DataFrame:
    """Lines of the animals that aren't deleted (action 2) and have a call among the kept markers (snps: snp_idx), with those markers only."""
    cells = geno.join(snps.select("snp_idx").distinct(), "snp_idx", "left_semi")
    wide = cells.groupBy("animal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("snp_idx", "g"))), lambda x: x["g"]).alias("geno"), F.count("g").alias("called")).where("called > 0")
    kept = wide.join(actions.where("action = 2").select("animal_id"), "animal_id", "left_anti")
    return geno_lines(kept.join(peds, "animal_id", "left").withColumn("id", F.col("animal_id")), layout, by)


def renumbered_ped(rows: DataFrame) -> DataFrame:
    """Lines of a renumbered pedigree: three numbers, sex, birth year, generation, observations, F to six places, three ids.

    Numbers are as wide as the largest, ids as the longest; unknown numbers are 0, unknown ids too.
    """
    n, wide = rows.agg(F.coalesce(F.max("nid"), F.lit(1)), F.coalesce(F.max(F.char_length(F.col("animal_id").cast("string"))), F.lit(1))).first()
    number = lambda c, w: F.lpad(F.coalesce(F.col(c), F.lit(0)).cast("string"), w, " ")
    size = len(str(n))
    cells = [F.concat(F.lit(" "), number(c, size)) for c in ("nid", "sire_nid", "dam_nid")]
    cells += [number("sex", 2), number("byr", 9), number("gen", 3), number("obs", 5), F.format_string("%10.6f", F.coalesce(F.col("f"), F.lit(0.0)))]
    cells += [F.concat(F.lit(" "), F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("0")), wide, " ")) for c in ("animal_id", "sire_id", "dam_id")]
    return rows.select("nid", F.concat(*cells).alias("value"))


def triplet_blocks(rows: DataFrame, n: int, magic: bytes = b"ATRP") -> DataFrame:
    """(part, content): rows (i, j, v) as triplet files of up to BLOCK_ENTRIES entries, each whole in itself."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            body = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([task + made], pa.int64()), pa.array([struct.pack(HEAD, magic, 1, n, len(body)) + body.tobytes()], pa.binary())], ["part", "content"])

        for batch in batches:
            part = np.empty(batch.num_rows, ENTRY)
            part["i"], part["j"], part["v"] = (batch.column(c).to_numpy() for c in range(3))
            held.append(part)
            size += len(part)
            if size >= BLOCK_ENTRIES:
                yield block()
                held, size, made = [], 0, made + 1
        if size:
            yield block()

    return rows.select("i", "j", "v").mapInArrow(pack, "part long, content binary")


def triplet_lines(rows: DataFrame, names: DataFrame, least: float = 1e-6) -> DataFrame:
    """Lines of triplets (i, j, v) above `least` with the ids (names: nid, id) of both numbers; NA where one has none."""
    a, b = names.select(F.col("nid").alias("i"), F.col("id").cast("string").alias("a")), names.select(F.col("nid").alias("j"), F.col("id").cast("string").alias("b"))
    named = rows.where(F.abs("v") > least).join(a, "i", "left").join(b, "j", "left")
    return named.select(F.format_string("%d %d %12.4f %s %s", "i", "j", "v", F.coalesce("a", F.lit("NA")), F.coalesce("b", F.lit("NA"))).alias("value"))


def matrix_lines(g: DataFrame) -> DataFrame:
    """Lines of the upper triangle (i <= j) of a symmetric matrix (i, j, g), the diagonal included, to 16 places."""
    return g.where("i <= j").select(F.format_string("%s %s %24.16E", F.col("i").cast("string"), F.col("j").cast("string"), F.col("g").cast("double")).alias("value"))


def diagonal_lines(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of the diagonal to four places, and of the diagonal less 1 to 16."""
    own = g.where("i = j")
    return (
        own.select(F.concat(F.lpad(F.row_number().over(_by_id()).cast("string"), 8, " "), F.lit("  "), F.rpad(F.col("i").cast("string"), 16, " "), F.format_string("%12.4f", F.col("g").cast("double"))).alias("value")),
        own.select(F.format_string("%s %24.16E", F.col("i").cast("string"), F.col("g").cast("double") - 1).alias("value")),
    )


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("i")


def removed(all_ids: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Lines of the ids that were there and weren't kept."""
    return all_ids.select(key).join(kept.select(key), key, "left_anti").select(F.col(key).cast("string").alias("value"))


def map_lines(markers: DataFrame) -> DataFrame:
    """Lines of a marker map, its header first."""
    head = markers.sparkSession.createDataFrame([(0, "\t".join(("SNP_ID", "CHR", "POS", "ARRAY_ALL", "ARRAY_CHR", "ALLELE1", "ALLELE2")))], "array_all int, value string")
    body = markers.select(F.col("array_all").cast("int"), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("snp_id", "chr", "pos", "array_all", "array_chr", "a1", "a2"))).alias("value"))
    return head.union(body).orderBy("array_all").select("value")


@F.pandas_udf(T.StringType())
def _percent(share: pd.Series) -> pd.Series:
    """Shares as C and Fortran write them, by their exact value: Java rounds halves up, so that 78.125 would be 78.13."""
    return share.map(lambda v: f"{v:8.2f}%")


def report_lines(counts: DataFrame, title: str, label: str = "label", value: str = "n") -> DataFrame:
    """Lines of a report: its title, then counts by label, with their shares of the total."""
    head = counts.sparkSession.createDataFrame([(0, "", f"== {title} ==")], "part int, label string, value string")
    total = counts.agg(F.sum(value).alias("_total"))
    share = F.col(value) * 100.0 / F.greatest(F.col("_total"), F.lit(1))
    body = counts.crossJoin(total).select(F.lit(1).alias("part"), F.col(label).cast("string").alias("label"), F.concat(F.rpad(F.col(label).cast("string"), 24, " "), F.lpad(F.col(value).cast("string"), 10, " "), _percent(share)).alias("value"))
    return head.union(body).orderBy("part", "label").select("value")
