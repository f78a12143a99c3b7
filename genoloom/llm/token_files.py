"""Token-id files: length-delimited binary records with masked checksums, and an offset index beside them.

A record file is a sequence of frames, all integers little-endian:

    length   u64   bytes of the payload
    check    u32   masked CRC-32 of the eight length bytes
    payload        flags u8 (1: doc_id is null), width u8 (bytes per id, 2 or 4), doc_id i64, ids
    check    u32   masked CRC-32 of the payload
    end      u8    0x0A

masked(c) = ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32. Files are named part-<n>-...-c<m>; records ascend by doc_id over the
files in the order of (n, m). The index is a Parquet table (file_no, file_part, record, doc_id, offset, length, start, n_tokens,
ids_crc32) in a folder of its own: a shuffled read looks up an offset and a length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, new_path, scan_partitions, table, whole_texts
from .tokens import END_ID, Encoder, tokenizer_path

_HEAD, _META = struct.Struct("<QI"), struct.Struct("<BBq")
#: Records of one file at most; with the size of a partition it bounds what a reader holds.
FILE_RECORDS = 20_000


def masked(data: bytes) -> int:
    """Checksum of data, rotated and shifted so that a checksum of checksums isn't degenerate."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """The record of one sequence; ids are unsigned 32-bit, stored in 16 bits where they fit."""
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    payload = _META.pack(doc_id is None, width, doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<IB", masked(payload), 10)


def frames(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length of the whole frame, doc_id, ids) of the records in data; raises ValueError on a broken one."""
    end = len(data) if end is None else end
    while at < end:
        if at + 12 > end:
            raise ValueError(f"truncated frame at {at}")
        size, check = _HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != check or size < 10 or at + size + 17 > end:
            raise ValueError(f"broken length at {at}")
        payload = data[at + 12 : at + 12 + size]
        if masked(payload) != int.from_bytes(data[at + 12 + size : at + 16 + size], "little"):
            raise ValueError(f"broken payload at {at}")
        if data[at + 16 + size] != 10:
            raise ValueError(f"broken end at {at}")
        null, width, doc_id = _META.unpack_from(payload)
        yield at, size + 17, None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")
        at += size + 17


def write_tokens(docs: DataFrame, path: str, vocabulary: Callable[[], str] = tokenizer_path, end_id: int = END_ID) -> None:
    """Encodes every whole text of docs (doc_id, text) and writes the record files to path, in ascending doc_id order.

    A null text is empty: its record holds the end id alone. Null doc_ids come first; equal doc_ids follow the hash
    of their text. Other columns are ignored. An empty table gives an empty folder. One shuffle, by ranges of doc_id,
    carries the texts; a lost task writes its file again through Spark's committer.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary())
        for batch in batches:
            out = [frame(i, ids)[:-1] for i, ids in zip(batch.column(0).to_pylist(), encoder.encode_each(batch.column(1), end_id), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(scan_partitions(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    records = rows.mapInArrow(encode, "record binary")  # without the end byte, which the line writer adds
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files in path, every checksum verified."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, part, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, start = [], 0
                for k, (offset, length, doc_id, ids) in enumerate(frames(content)):
                    rows.append((no, part, k, doc_id, offset, length, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                columns = list(zip(*rows, strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], _INDEX)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    number = lambda p: F.regexp_extract(name, p, 1).cast("long")
    return files.select(number(r"^part-(\d+)").alias("no"), number(r"-c(\d+)\.").alias("part"), "content").mapInArrow(parse, ", ".join(f"{c} long" for c in _INDEX))


_INDEX = ["file_no", "file_part", "record", "doc_id", "offset", "length", "in_file", "n_tokens", "ids_crc32"]


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Reads the record files back, and writes and returns their index with each record's start among all ids."""
    staged = f"{index}-staged"
    read_records(spark, path).write.parquet(staged)
    rows = spark.read.parquet(staged)
    before = Window.orderBy("file_no", "file_part").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file_no", "file_part").agg(F.sum("n_tokens").alias("total"))  # a row per file
    files = files.select("file_no", "file_part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    out = rows.join(files, ["file_no", "file_part"]).withColumn("start", F.col("base") + F.col("in_file"))
    out.select("file_no", "file_part", "record", "doc_id", "offset", "length", "start", "n_tokens", "ids_crc32").write.parquet(index)
    delete(spark, staged)
    return spark.read.parquet(index)


def shuffled_read(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(doc_id, ids) of the records that the rows of index (file_no, file_part, offset, length) point to, in any order.

    The places wanted of a file, FILE_RECORDS at most but for repeats, meet its one row; contents aren't copied for each record.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer().to_pybytes()
                found = [next(frames(data, p["offset"], p["offset"] + p["length"])) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in found], pa.int64()), pa.array([x[3].tolist() for x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    number = lambda p: F.regexp_extract(name, p, 1).cast("long")
    files = files.select(number(r"^part-(\d+)").alias("file_no"), number(r"-c(\d+)\.").alias("file_part"), "content")
    wanted = index.groupBy("file_no", "file_part").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    return files.join(wanted, ["file_no", "file_part"]).select("places", "content").mapInArrow(pick, "doc_id long, ids array<long>")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum, as read back from the files."""
    path = new_path(spark, "records")
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return write_index(spark, path, new_path(spark, "index")).select("doc_id", "start", "n_tokens", "ids_crc32")
