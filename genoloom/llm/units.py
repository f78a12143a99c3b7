"""Units of whole documents and a question-and-answer exchange between them.

A unit holds a few megabytes of documents and has a stable number, because it is written before it is used. To learn
which of its fingerprints occur elsewhere, a unit sends each distinct one once, to the bucket that owns it; the bucket
answers every unit with one bit per fingerprint. A key in a third of all documents costs a bucket one
fingerprint per unit, and answers are an eighth of a byte each. Hashes only choose what is compared: see segments.py.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from itertools import batched, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_texts, written

#: Text of a unit; a longer document is a unit of its own.
UNIT_BYTES = 2 << 20
#: Units that may hold a key before it is hot: its segments are then dealt to many buckets.
HOT = 256
#: Units for each bucket.
UNITS_PER_BUCKET = 4

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """The base to 0 .. n - 1 modulo 2**64, or those of its inverse; kept for the worker's life."""
    if inverse not in _POWERS or len(_POWERS[inverse]) < n:
        step = np.full(max(n, 1 << 16), pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
        step[0] = 1
        _POWERS[inverse] = np.cumprod(step)
    return _POWERS[inverse][:n]


class Rolling:
    """Hashes of any stretch of a sequence of unsigned 64-bit values, equal for equal stretches wherever they stand.

    Unequal stretches may have equal hashes, and there are texts made to: hashes find candidates and decide nothing.
    """

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(len(values)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * _powers(len(self.sums), True)[starts]

    def every(self, size: int) -> np.ndarray:
        """Of each stretch of that size."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * _powers(len(self.sums), True)[:n] if n > 0 else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads what differs over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Unit:
    """Documents of one unit: their ids, and their bytes joined with a line feed after each."""

    def __init__(self, data: bytes):
        held = pa.ipc.open_stream(data).read_all()
        self.doc_ids = held.column(0).to_pylist()
        texts = held.column(1).to_pylist()
        self.bytes = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes


def make_units(docs: DataFrame, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """docs (doc_id, text) as a written table (unit, data) of compressed units; a null text is empty."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, options = TaskContext.get().partitionId() << 32, 0, pa.ipc.IpcWriteOptions(compression="zstd")
        ids, texts, size = [], [], 0

        def unit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch)
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["unit", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= unit_bytes:
                    yield unit()
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield unit()

    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(build, "unit long, data binary"), "units")


Replies = dict[int, bytes]


def told(units: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """units with a column reply_<n> for each table of replies, which grow with the units and so are never broadcast."""
    out = units
    for n, r in enumerate(replies):
        out = out.join(r.withColumnRenamed("reply", f"reply_{n}").hint("merge"), "unit", "left")
    return out


def each_unit(df: DataFrame, work: Callable[[Unit, list[Replies]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work yields for each unit of df (of told) and the replies to it, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                replies = [{r["bucket"]: r["answer"] for r in batch.column(c)[i].as_py() or ()} for c in range(2, batch.num_columns)]
                number = batch.column(0)[i].as_py()
                for out in work(Unit(batch.column(1)[i].as_py()), replies):
                    yield pa.RecordBatch.from_arrays([pa.array([number] * out.num_rows, pa.int64()), *out.columns], ["unit", *out.schema.names])

    return df.mapInArrow(run, "unit long, " + schema)


Answer = Callable[[Iterator[bytes]], Iterator[bytes]]


def ask(df: DataFrame, send: Callable[[Unit, list[Replies]], Iterator[tuple[int, bytes]]], answer: Answer, partitions: int) -> DataFrame:
    """Replies (unit, reply array<struct<bucket, answer>>), written: send gives a unit's messages by bucket; answer reads the
    messages of one bucket once, keeping what it needs of them, and yields an answer to each in their order."""

    def messages(unit: Unit, replies: list[Replies]) -> Iterator[pa.RecordBatch]:
        sent = list(send(unit, replies))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sent], pa.int64()), pa.array([m for _, m in sent], pa.binary())], ["bucket", "message"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for bucket, group in groupby(rows, key=itemgetter(0)):
            units = array("q")

            def read(group=group, units=units) -> Iterator[bytes]:
                for _, unit, message in group:
                    units.append(unit)
                    yield message

            at = 0
            for answers in batched(answer(read()), 4096):
                to = units[at : at + len(answers)]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([bucket] * len(to), pa.int64()), pa.array(answers, pa.binary())], ["unit", "bucket", "answer"])
                at += len(answers)

    dealt = each_unit(df, messages, "bucket long, message binary").select("bucket", "unit", "message").repartition(partitions, "bucket").sortWithinPartitions("bucket", "unit")
    answers = dealt.mapInArrow(run, "unit long, bucket long, answer binary")
    return written(answers.groupBy("unit").agg(F.collect_list(F.struct("bucket", "answer")).alias("reply")), "replies")


class Shared:
    """Which of a unit's fingerprints occur again: in the unit itself, or by a bucket's answer in another unit."""

    def __init__(self, owner: np.ndarray, value: np.ndarray, buckets: int):
        """owner: decides the bucket; value: what is compared there, of the width that is sent."""
        bucket = (owner % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((value, bucket))
        b, v = bucket[order], value[order]
        fresh = np.ones(len(v), bool)
        fresh[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
        group = np.cumsum(fresh) - 1
        self.group = np.empty(len(v), np.int64)  # of each fingerprint, its place among the distinct ones
        self.group[order] = group
        self.value, self.bucket = v[fresh], b[fresh]
        self.again = np.bincount(group, minlength=len(self.value)) > 1 if len(v) else np.zeros(0, bool)

    def messages(self) -> Iterator[tuple[int, bytes]]:
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.bucket)], strict=True):
            if e > s:
                yield int(self.bucket[s]), self.value[s:e].tobytes()

    def _told(self, replies: Replies, plane: int) -> np.ndarray:
        there = np.zeros(len(self.value), bool)
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.bucket)], strict=True):
            if e > s:
                size = -(-(e - s) // 8)
                there[s:e] = np.unpackbits(np.frombuffer(replies[int(self.bucket[s])], np.uint8, size, plane * size), count=e - s).astype(bool)
        return there

    def repeated(self, replies: Replies) -> np.ndarray:
        """For each fingerprint, whether it occurs again."""
        return (self._told(replies, 0) | self.again)[self.group]

    def hot(self, replies: Replies) -> np.ndarray:
        """For each fingerprint, whether more than HOT units have it."""
        return self._told(replies, 1)[self.group]


def in_several(dtype) -> Answer:
    """Answers messages of distinct values with a bit for each that another message holds too, then one for each that more than HOT hold."""
    limit = HOT

    def answer(messages: Iterator[bytes]) -> Iterator[bytes]:
        values = [np.frombuffer(m, dtype) for m in messages]
        kept, counts = np.unique(np.concatenate(values), return_counts=True)
        for v in values:
            many = counts[np.searchsorted(kept, v)]
            yield np.packbits(many > 1).tobytes() + np.packbits(many > limit).tobytes()

    return answer


def sliding(x: np.ndarray, size: int, pick: Callable) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each stretch of that size."""
    span, count = 1, len(x) - size + 1
    while 2 * span <= size:
        x = pick(x[: len(x) - span], x[span:])
        span *= 2
    return pick(x[:count], x[size - span : size - span + count])
