"""Packing: the rule against a brute-force sum of squares, whole pieces, no gaps, few sequences."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.llm import packing as P
from genoloom.llm.tokens import Encoder, tokenizer_path


def ids_of(text):
    encoder = Encoder.of(tokenizer_path())
    return np.append(np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(1))


def check(rows, docs, capacity):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc, text in docs:
        ids = ids_of(text)
        for k, s in enumerate(range(0, len(ids), capacity)):
            want[doc, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].astype("<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(r.length for r in rows)
    return len(by_seq), -(-total // capacity)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    made, least = check(P.op8_best_fit_packing(spark, sf).collect(), docs, 4096)
    assert made <= least + 2


@pytest.mark.parametrize("shard", [7, 10_000])
def test_shards_and_edges(spark, shard):
    docs = [(i % 50, "word " * (i % 37)) for i in range(200)] + [(None, None), (None, ""), (7, "x y " * 4000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("offset", F.lit(1)).repartition(3)
    rows = P.pack_documents(table, 64, shard).collect()
    made, least = check(rows, docs, 64)
    assert made <= least * 1.1 + 2
    assert P.pack_documents(table.limit(0), 64).count() == 0


def test_rule_is_the_least_sum_of_squares():
    capacity, sizes = 20, np.random.default_rng(3).integers(1, 21, 300)
    where, offset = P.sum_of_squares(sizes, capacity)
    gaps: dict[int, int] = {}
    for size, w, o in zip(sizes.tolist(), where.tolist(), offset.tolist(), strict=True):
        options = [g for g in set(gaps.values()) if g >= size] + [capacity]
        gap = gaps.get(w, capacity)
        assert capacity - gap == o
        n = Counter(g for g in gaps.values() if g > 0)

        def after(g, size=size, n=n):
            m = Counter(n)
            if g != capacity:
                m[g] -= 1
            m[g - size] += 1
            return sum(v * v for k, v in m.items() if k > 0)

        assert after(gap) == min(after(g) for g in options)
        gaps[w] = gap - size
