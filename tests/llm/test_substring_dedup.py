"""Substring dedup over words, and the exchange below it, against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.llm import substring_dedup as D
from genoloom.llm import units as U


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d.doc_id: (n, r, hashlib.sha256(k.encode()).hexdigest()) for d, (n, r, k) in zip(docs, brute([d.text for d in docs], 35), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in D.op10_substring_dedup(spark, sf).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 0


def test_covers():
    for v, cover in D.COVERS.items():
        assert {(a - b) % v for a, b in itertools.product(cover, cover)} == set(range(v))


@pytest.mark.parametrize(("window", "hot"), [(3, 256), (12, 1), (12, 256), (35, 0), (35, 2)])
def test_few_words(spark, monkeypatch, window, hot):
    """Chance repeats, overlaps within a document, equal rows, many small units and hot keys."""
    monkeypatch.setattr(U, "UNIT_BYTES", 500)
    monkeypatch.setattr(U, "HOT", hot)
    rng = random.Random(window)
    texts = [" ".join(rng.choices("abc" if window < 35 else "ab", k=rng.randint(0, 60))) for _ in range(60)]
    shared = " ".join(rng.choices("abcdefgh", k=80))
    texts += [f"x{i} y{i}  {shared[: 20 + 10 * i]}\t{i}" for i in range(12)] + [None, "", " \n", texts[0], texts[0], "z " * 5000, "é ü ö " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in D.dedup_words(docs, window).collect()}
    assert got == dict(enumerate(brute(texts, window)))


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed, r.kept) for r in D.dedup_words(docs, 2).collect()) == [(0, 0, ""), (2, 2, ""), (2, 2, "")]
    assert D.dedup_words(docs.limit(0)).count() == 0


def test_rolling_hashes():
    x = np.random.default_rng(0).integers(0, 4, 3000).astype(np.uint64)
    r = U.Rolling(x)
    h = r.every(7)
    seen = {}
    for i in range(len(h)):
        assert seen.setdefault(int(h[i]), x[i : i + 7].tobytes()) == x[i : i + 7].tobytes()
    assert len(seen) == len({x[i : i + 7].tobytes() for i in range(len(h))})
    assert (r.of(np.arange(10), np.arange(10) + 7) == h[:10]).all()


def test_texts_of_equal_hashes(spark):
    """Words that polynomial hashes modulo a power of two can't tell apart: a Thue-Morse word and its complement."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{i}" for i in range(34))
    texts = [f"{same} {one}", f"{same} {two}", " ".join([one] * 40), " ".join([two] * 40)]
    texts += [" ".join(["xy"[i.bit_count() % 2] for i in range(4096)]), " ".join(["yx"[i.bit_count() % 2] for i in range(4096)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in D.dedup_words(docs).collect()}
    assert got == dict(enumerate(brute(texts, 35)))
    assert got[0][1] == got[1][1] == 0 and got[2][1] == 40


def test_texts_of_megabytes(spark):
    rng = random.Random(5)
    words = [f"{rng.getrandbits(24):x}" for _ in range(400_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "\n".join(words[200_000:200_500]) + " !"), (3, "short")], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in D.dedup_words(docs).collect()} == {1: (400_000, 500), 2: (501, 500), 3: (1, 0)}
