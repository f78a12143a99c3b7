"""Token files: exact round trip, index, damage, and ids equal to the tokenizer's."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.llm import token_files as T
from genoloom.llm.tokens import Encoder, tokenizer_path


def ids_of(text):
    return [*Encoder.of(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_query(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.op7_token_files(spark, sf).collect()}
    start = 0
    for doc, text in docs:
        ids = np.array(ids_of(text), "<u4")
        assert got[doc] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_round_trip_and_shuffled_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_RECORDS", 3)
    texts = ["a b", None, "", "ΑΣ Σ. İstanbul don't x<|endoftext|>y é ́x\x1cb c\x85d  ﬁ 123 _a-b_", "w " * 20000, "a b", "\n"]
    docs = spark.createDataFrame([*((10 - i, t) for i, t in enumerate(texts)), (None, "n"), (4, "again")], "doc_id long, text string").withColumn("record", F.lit(1))
    path = str(tmp_path / "records")
    T.write_tokens(docs, path)
    index = T.write_index(spark, path, str(tmp_path / "index")).orderBy("start").collect()
    assert [r.doc_id for r in index] == [None, 4, 4, 5, 6, 7, 8, 9, 10]
    assert [r.start for r in index] == [sum(x.n_tokens for x in index[:i]) for i in range(len(index))]
    rows = spark.read.parquet(str(tmp_path / "index")).where("doc_id in (6, 7, 9)")
    got = {r.doc_id: r.ids for r in T.shuffled_read(spark, path, rows).collect()}
    assert got == {10 - i: ids_of(texts[i]) for i in (4, 3, 1)}
    T.write_tokens(docs.limit(0), str(tmp_path / "none"))
    assert T.write_index(spark, str(tmp_path / "none"), str(tmp_path / "none-index")).count() == 0


def test_damage_is_found():
    data = T.frame(7, np.array([1, 2, 70000], "<u4")) + T.frame(None, np.zeros(0, "<u4"))
    assert [(d, ids.tolist()) for _, _, d, ids in T.frames(data)] == [(7, [1, 2, 70000]), (None, [])]
    one = T.frame(7, np.array([1, 2, 70000], "<u4"))
    for at in range(len(one) - 1):  # the end byte alone isn't covered by a checksum
        broken = bytearray(one)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(T.frames(bytes(broken)))
    with pytest.raises(ValueError):
        list(T.frames(data[:-3]))


def test_damaged_end():
    data = T.frame(5, np.array([1, 2], np.uint32))
    assert [r[2] for r in T.frames(data)] == [5]
    with pytest.raises(ValueError, match="end"):
        list(T.frames(data[:-1] + b"x"))


def test_known_tokenizer_goes_by_chunk():
    assert Encoder(tokenizer_path()).by_chunk
