"""Decontamination against brute force."""

import hashlib
import random
import re

import pytest

from genoloom.llm import common
from genoloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    doc, hit, found = words(text), set(), set()
    for item, other in items:
        other = words(other)
        n = min(window, len(other))
        grams = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1):
            if n and tuple(doc[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(item)
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def test_query_equals_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.op5_decontaminate(spark, sf).collect()}
    assert got == {i: brute(t, items) for i, t in docs.items()}
    assert any(x[4] for x in got.values())


@pytest.mark.parametrize(("hot", "bits"), [(0, 26), (100, 26), (100, 8)])
def test_small_alphabet(spark, monkeypatch, hot, bits):
    """Few words make many ties, repeats and chance hits; all windows are hot or none, and the table is wide or nearly full."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(D, "TABLE_BITS", bits)
    rng = random.Random(7)
    make = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([0, 1, 3, 9, 10, 11, 14][: 4 if hot == 0 else 7])]
    docs = [(i, make(rng.randint(0, 40)), 1) for i in range(60)] + [(100, None, 1), (101, "", 1), (102, "Ä é-Ö_x1" * 3000, 1), (None, "a b", 1)]
    bench = spark.createDataFrame([*items, (None, "a b a b"), (50, None)], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in D.contamination(table, bench).collect()}
    assert got == {i: brute(t, items)[:3] for i, t, _ in docs}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    row = D.contamination(docs, bench).first()
    assert (row.n_words, row.n_hit, row["items"], row.runs) == (3, 0, [], [])
    assert D.contamination(docs.limit(0), bench).count() == 0


def test_repeated_rows_and_runs(spark):
    """Equal documents are judged each alone, with their own runs; hits beyond a window are extended."""
    item = " ".join(f"w{i}" for i in range(14))
    text = f"a b {item} c {' '.join(item.split()[:11])}"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, item.upper(), "y"), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 z", "y")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, item + " tail")], "item_id long, text string")
    got = sorted((r.doc_id, r.source, r.n_words, r.n_hit, r.runs, r["items"]) for r in D.contamination(docs, bench).collect())
    one = (1, "x", 28, 25, [2, 16, 17, 28], [7, 8])
    assert got == [one, one, (2, "y", 14, 14, [0, 14], [7, 8]), (3, "y", 10, 0, [], [])]
