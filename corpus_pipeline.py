"""A cleaning pipeline for training texts: toxic documents go, one of each group of near-copies stays, documents with
benchmark passages go, secrets are masked, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents, whatever other columns those have: names that operators use as well don't clash. Null texts and empty tables pass
through every stage; nothing is capped or sampled but the labelled rows on which the toxicity models are fitted
(toxicity.SAMPLE of each class).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import decontaminate, packing, secrets, simhash, toxicity
from genoloom.llm.common import table, written


def _apart(docs: DataFrame) -> DataFrame:
    """docs with its other columns under names that no operator uses, so that none of theirs clashes."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_kept_{n}") for n, c in enumerate(docs.columns)))


def _back(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, by their names, from what an operator made of _apart(docs)."""
    return done.select(*(F.col(c if c in ("doc_id", "text") else f"_kept_{n}").alias(c) for n, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, doesn't reject."""
    chain = toxicity.fit_labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _back(toxicity.score(_apart(docs), chain).where("not rejected"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose five-word shingles are alike (0.8 or more): the smallest doc_id.

    Rows are told apart by doc_id and text; of equal rows one stays. Texts without words are one class.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text")))
    rows = _apart(docs).withColumn("key", key)
    first = simhash.near_duplicates(rows.select("key", "doc_id", "text")).where("key = first_key").select("key")
    return _back(rows.join(first, "key", "left_semi").dropDuplicates(["key"]), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.contamination(_apart(docs), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return _back(found.where("n_hit = 0"), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mask, and n_chars as it is then."""
    found = secrets.find_secrets(_apart(docs))
    done = secrets.redact(found.withColumn("masked", F.size("secrets") > 0))
    chars = F.col(f"_kept_{docs.columns.index('n_chars')}")
    sized = done.withColumn(f"_kept_{docs.columns.index('n_chars')}", F.when(F.col("masked"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(chars))
    return _back(sized, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents with its place in a sequence."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: The stages aren't SQL: a fitted model, sampled blocks and a sequential packing rule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
