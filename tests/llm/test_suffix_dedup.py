"""Suffix arrays against sorting, and the dedup query against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.llm import suffix_dedup as S
from genoloom.llm import units as U


@pytest.mark.parametrize(("n", "k"), [(1, 2), (2, 2), (50, 1), (300, 2), (400, 3), (900, 26), (500, 250)])
def test_suffix_array(n, k):
    for seed in range(5):
        s = np.append(np.random.default_rng(seed).integers(1, k + 1, n), 0)
        data = bytes(s.tolist())
        want = sorted(range(len(s)), key=lambda i: data[i:])
        sa = S.suffix_array(s)
        assert sa.tolist() == want
        common = S.permuted_common_prefixes(s, sa, 12)
        for a, b in zip(want, want[1:], strict=False):
            lcp = next(d for d in range(len(s)) if data[a + d] != data[b + d])
            assert common[b] == min(12, lcp)


@pytest.mark.parametrize("most", [5, 7, 20, 400])
def test_long_repeats(most):
    """Periods and repeats longer than any prefix that is asked for."""
    rng = random.Random(2)
    part = bytes(rng.choices(range(1, 5), k=60))
    s = np.append(np.frombuffer(part * 9 + bytes(rng.choices(range(1, 5), k=300)) + part + b"\x02" * 90, np.uint8).astype(int), 0)
    sa, data = S.suffix_array(s), bytes(s.tolist())
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: data[i:])
    common = S.permuted_common_prefixes(s, sa, most)
    for a, b in zip(sa.tolist(), sa.tolist()[1:], strict=False):
        lcp = next(d for d in range(len(s)) if data[a + d] != data[b + d])
        assert common[b] == min(most, lcp)


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - window + 1):
            if count[d[i : i + window]] > 1:
                gone[i + 1 : i + 1 + window] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(d), int(gone.sum()), spans, bytes(b for i, b in enumerate(d) if not gone[i + 1])))
    return out


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d.doc_id: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for d, x in zip(docs, brute([d.text for d in docs], 200), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op6_suffix_dedup(spark, sf).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 0


def test_sql_equals_brute_force(sf):
    import duckdb

    docs = duckdb.sql(f"select * from '{sf}/documents.parquet'")
    rows = docs.fetchall()
    want = {r[0]: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for r, x in zip(rows, brute([r[1] for r in rows], 200), strict=True)}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.execute(S.oracle()).fetchall()} == want


@pytest.mark.parametrize(("window", "gram", "hot"), [(6, 2, 256), (6, 2, 1), (30, 8, 0), (200, 24, 1), (200, 24, 256)])
def test_hard_texts(spark, monkeypatch, window, gram, hot):
    """Chance repeats, periods, long runs of one character, multi-byte characters, equal rows, many small units and hot keys."""
    monkeypatch.setattr(U, "UNIT_BYTES", 600)
    monkeypatch.setattr(U, "HOT", hot)
    rng = random.Random(window)
    texts = ["".join(rng.choices("ab" if window > 6 else "abcd", k=rng.randint(0, 90))) for _ in range(40)]
    shared = "".join(rng.choices("abcdefgh é", k=500))
    texts += [f"{i}|{shared[7 * i : 150 + 30 * i]}|{i}" for i in range(10)]
    texts += [None, "", texts[0], texts[0], "a" * 1000, "xy" * 300, "0123456789" * 60, "é" * 250, "\0" * 300, "ÿ\0" * 150, "q" * (window - 1), "p" * window, "r" * (window + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.dedup_bytes(docs, window, gram).collect()}
    want = dict(enumerate(brute(texts, window)))
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert len(got) == len(want)


def test_empty(spark):
    docs = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r) for r in S.dedup_bytes(docs).collect()] == [(None, 0, 0, 0, bytearray())]
    assert S.dedup_bytes(docs.limit(0)).count() == 0


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_texts_of_equal_hashes(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo any power of two."""
    one, two = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    assert (U.Rolling(np.frombuffer(one.encode(), np.uint8).astype(np.uint64)).every(4096) == U.Rolling(np.frombuffer(two.encode(), np.uint8).astype(np.uint64)).every(4096)).all()
    docs = spark.createDataFrame(list(enumerate(["x" + one, two + "y"])), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.dedup_bytes(docs, 2100, 2080).collect()}
    assert got == dict(enumerate(brute(["x" + one, two + "y"], 2100)))


def test_texts_of_megabytes(spark):
    """One document of many units' size, which repeats a part of another."""
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghij klmnop", k=3 << 20))
    docs = spark.createDataFrame([(1, text), (2, text[1 << 20 : (1 << 20) + 5000] + "!"), (3, "short")], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in S.dedup_bytes(docs).collect()} == {1: (5000, 1), 2: (5000, 1), 3: (0, 0)}
