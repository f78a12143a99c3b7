"""The pipeline, stage by stage."""

import re

import corpus_pipeline as C
from genoloom.llm import decontaminate, secrets
from genoloom.llm.common import written

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    seen = {}
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SF), name)
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    first, near, clean, masked = seen.values()
    assert len(first.keys() & toxic) <= 0.3 * len(toxic) and len(first) > 0.85 * len(before)
    assert set(near) <= set(first) and len(set(near.values())) == len(near)
    assert {t for t in near.values()} <= set(first.values())
    hit = {r.doc_id for r in decontaminate.contamination(spark.createDataFrame(list(near.items()), "doc_id long, text string"), bench).where("n_hit > 0").collect()}
    assert hit and set(clean) == set(near) - hit
    assert set(masked) == set(clean)
    changed = {i for i in clean if clean[i] != masked[i]}
    assert changed and all("[SECRET]" in masked[i] for i in changed)
    assert not any(re.search(r"AKIA[A-Z0-9]{16}", t) for t in masked.values())
    assert secrets.find_secrets(spark.createDataFrame(list(masked.items()), "doc_id long, text string")).where("size(secrets) > 0").count() == 0
    assert {r.doc_id for r in docs.collect()} == set(masked)


def test_hard_rows(spark):
    """Null and empty texts, null ids, equal rows and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "one two three four five six", None, "s", 27), (3, "one two three four five six", "en", "s", 27), (4, "token=abcdef123", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        for _, stage in C.STAGES:
            table = written(stage(spark, table, SF), "stage")
        got = sorted(r.doc_id for r in table.collect() if r.doc_id is not None)
        assert got in ([1, 2, 4], [])
