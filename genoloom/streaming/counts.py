"""Marker counts of an arriving stream of genotypes: counts are additive, so each batch is merged into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def batch_counts(geno: DataFrame) -> DataFrame:
    """n0, n1, n2 and records per marker."""
    one = lambda g: F.sum((F.col("g") == g).cast("long")).alias(f"n{g}")
    return geno.groupBy("snp_idx").agg(*(F.coalesce(one(g), F.lit(0)).alias(f"n{g}") for g in range(3)), F.count("*").alias("n"))


def start_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the counts of each batch of (animal_id, snp_idx, g) below path, one folder a batch: a batch that is
    repeated after a failure replaces its own folder, so totals count it once."""

    def put(batch: DataFrame, number: int) -> None:
        batch_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(df: DataFrame) -> DataFrame:
    """Counts over all batches of a table that start_counts writes."""
    return df.groupBy("snp_idx").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "n2", "n")))
