"""Best-fit packing of documents into fixed-length sequences by the sum-of-squares rule.

With N(g) the number of open sequences whose gap is g, a piece goes where the sum of N(g) squared becomes smallest:
into an open sequence of some gap, or a new one. Shards of pieces are packed side by side; the sequences that they leave
open are pieces of the next level, until one shard is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_texts, written
from .tokens import END_ID, Encoder, tokenizer_path

CAPACITY = 4096
#: Pieces of a shard; each level's shards hold about so many. It bounds a task's memory.
SHARD = 40_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, taken in the given order; sizes from 1 to capacity.

    Ties go to the smaller gap left, and of equal gaps to the sequence that had it last.
    """
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # N(g); closed sequences (gap 0) aren't counted
    where, offset, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        # moving a sequence from gap g to g - size changes the sum by 2 (N(g - size) - N(g) + 1), closing one by 1 - 2 N(g)
        had = count[size:]
        left = np.flatnonzero(had)  # gaps that would be left
        best = None
        if len(left):
            scores = 2 * (count[left] - had[left] + 1)
            if left[0] == 0:
                scores[0] -= 1
            least = int(np.argmin(scores))
            best, score = int(left[least]), int(scores[least])
        fresh = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
        if best is not None and score <= fresh:
            gap = best + size
            bin_no = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_no = capacity, made
            made += 1
        where[i], offset[i] = bin_no, capacity - gap
        if gap > size:
            open_by_gap[gap - size].append(bin_no)
            count[gap - size] += 1
    return where, offset


def _level(pieces: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """pieces (key, size) with sequence and offset; shards are dealt by the key's hash and packed in the order of another hash."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        held = pd.concat(rows, ignore_index=True) if rows else pd.DataFrame({"shard": [], "key": []})
        for shard, own in held.groupby("shard"):
            own = own.sort_values(["turn", "key"])
            where, offset = sum_of_squares(own["size"].to_numpy(), capacity)
            yield pd.DataFrame({"key": own["key"].to_numpy(), "size": own["size"].to_numpy(), "sequence": (level << 58) + (int(shard) << 32) + where, "offset": offset})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard") if shards > 1 else dealt.coalesce(1)
    return dealt.select("shard", "key", "size", F.xxhash64("key").alias("turn")).mapInPandas(place, "key long, size long, sequence long, offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """pieces (key long, size) with `sequence_id` and `offset`: every piece whole, no sequence over capacity, no gaps.

    key is unique; sizes are 1 to capacity. Each level packs shards of bounded size; only sequences still open go on,
    as pieces of their own, so that later levels shrink. Ties are settled by key: equal input gives equal output.
    """
    pieces = written(pieces.select("key", F.col("size").cast("long").alias("size")), "pieces")
    count, level = pieces.count(), 1
    shards = max(1, -(-count // shard))
    placed = written(_level(pieces, shards, level, capacity), "packed")
    while shards > 1:
        bins = placed.groupBy("sequence").agg(F.sum("size").alias("size"))
        left = written(bins.where(F.col("size") < capacity).select(F.col("sequence").alias("key"), "size"), "open")
        remaining = left.count()
        before, shards = shards, max(1, -(-remaining // shard))
        shards = min(shards, before - 1)
        level += 1
        again = written(_level(left, shards, level, capacity), "repacked").select(F.col("key").alias("sequence"), F.col("sequence").alias("over"), F.col("offset").alias("base"))
        moved = placed.join(again, "sequence", "left")
        placed = written(moved.select("key", "size", F.coalesce("over", "sequence").alias("sequence"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")), "packed")
        if again.select("over").distinct().count() > 0.99 * remaining:  # what is open doesn't fit together
            break
    return placed.select("key", "size", F.col("sequence").alias("sequence_id"), "offset")


def cut(docs: DataFrame, capacity: int = CAPACITY, vocabulary: Callable[[], str] = tokenizer_path, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each whole text: (doc_id, row, piece, start, length, ids_crc32); row names the input row.

    A null text is empty: its only piece is the end id. Only texts of more than capacity ids are cut.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary())
        for batch in batches:
            out: list[tuple] = []
            for doc, row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoder.encode_each(batch.column(2), end_id), strict=True):
                out += [(doc, row, k, s, len(part := ids[s : s + capacity]), zlib.crc32(part.astype("<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(tokens, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Every piece of docs (doc_id, text) with its place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Repeated and null doc_ids are rows of their own. An empty table gives no rows; other columns are ignored.
    """
    pieces = written(cut(docs, capacity).withColumn("key", F.monotonically_increasing_id()), "cut")
    placed = pack(pieces.select("key", F.col("length").alias("size")), capacity, shard)
    return pieces.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
