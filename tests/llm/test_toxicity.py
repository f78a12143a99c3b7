"""Toxicity: held-out accuracy, the chain's order, and edge cases."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from genoloom.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    chain = T.fit_labelled(docs, labels.where("doc_id % 3 <> 0"))
    assert chain.categories[-1] == "toxic" and len(chain.categories) > 1
    scored = T.score(docs.join(held, "doc_id"), chain).select("toxic", "rejected").collect()
    toxic = [r.rejected for r in scored if r.toxic]
    clean = [r.rejected for r in scored if not r.toxic]
    assert np.mean(toxic) >= 0.7 and np.mean(clean) <= 0.02


def test_later_models_see_earlier_categories():
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i)}" * 3 for i in range(12)]
    texts, first, second = [], [], []
    for _ in range(400):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        texts.append(" ".join([*rng.choice(words, 12), *(["vile"] if a else []), *(["scorn"] if b else [])]))
        first.append(a)
        second.append(a or b)
    chain = T.fit(pa.array(texts), {"vile": np.array(first, float), "toxic": np.array(second, float)})
    assert [len(w) for w in chain.weights] == [len(chain.words) + 1, len(chain.words) + 2]
    assert chain.weights[1][-2] > 0.5  # the first category's probability
    p = chain.predict(chain.matrix(pa.array(texts)))
    assert ((p[:, 1] >= chain.threshold) == np.array(second)).mean() > 0.97


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "\n\t 12 34"), (4, "clean words only"), (5, "idiot scum " * 30000), (None, "idiot scum")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("p_toxic", F.lit("x")).withColumn("odd `name`", F.lit(1)).drop("odd `name`")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 140)] + [(100, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    train = spark.createDataFrame([(i, "idiot scum here" if i % 2 else "clean words only") for i in range(100, 140)], "doc_id long, text string")
    chain = T.fit_labelled(train, labels)
    got = {r.doc_id: r.rejected for r in T.score(docs, chain).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: True, None: True}
    assert T.score(docs.limit(0), chain).count() == 0
    none = T.fit_labelled(train, labels.limit(0))
    assert {r.rejected for r in T.score(docs, none).collect()} == {False}


def test_fit_is_bounded(spark, monkeypatch):
    """However often an id is repeated, one of its texts is read, and none that goes beyond the bytes."""
    docs = spark.range(20000).selectExpr("id % 10 as doc_id", "concat('word ', repeat('x', cast(id % 7 as int)), case when id % 10 = 3 then repeat(' long', 300) else '' end) as text")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0, None) for i in range(10)], "doc_id long, toxic int, insult boolean, threat int")
    known = labels.select("doc_id", "toxic")
    held = T._sampled(docs, known, 3)
    assert held.num_rows == len(set(held["doc_id"].to_pylist())) == 6
    monkeypatch.setattr(T, "SAMPLE_BYTES", 200)
    assert sum(len(t) for t in T._sampled(docs, known, 10)["text"].to_pylist()) <= 200
    assert 3 not in T._sampled(docs, known, 10)["doc_id"].to_pylist()
    chain = T.fit_labelled(docs, labels)
    assert chain.categories == ["insult", "threat", "toxic"]


def test_fit_leaves_the_driver(spark, monkeypatch):
    """The sampled texts go to a task; the driver gets the fitted chain alone, the same as from the sample itself."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = T._sampled(docs, known, T.SAMPLE)
    lang = np.array(held["lang"].to_pylist(), object)
    toxic = held["toxic"].to_numpy().astype(float)
    names, counts = np.unique(lang[toxic > 0].astype(str), return_counts=True)
    own = {f"toxic_{n}": toxic * (lang == n) for n in names[np.argsort(-counts, kind="stable")][:4]}
    want = T.fit(held["text"].combine_chunks(), own | {"toxic": toxic})
    for name in ("fit", "_sampled"):
        monkeypatch.setattr(T, name, None)  # the driver's alone
    chain = T.fit_labelled(docs, labels)
    assert (chain.categories, chain.words, chain.threshold) == (want.categories, want.words, want.threshold)
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(chain.weights, want.weights, strict=True))  # sums of single precision


def test_clean_and_toxic_by_hand(spark):
    """Every row of a small table against the rule that made it."""
    rows = [(i, " ".join((["vile"] if i % 4 == 0 else []) + [f"{a}{b}" for a in "abcdefgh" for b in ("in", "on", "al")][i % 5 : i % 5 + 9])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200, 2)], "doc_id long, toxic int")
    got = {r.doc_id: r.rejected for r in T.score(docs, T.fit_labelled(docs, labels)).collect()}
    assert got == {i: i % 4 == 0 for i, _ in rows}
