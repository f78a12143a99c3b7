"""URL filter against DuckDB on the pages, and by hand."""

import duckdb
import pytest

from genoloom.llm import url_filter as U


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    key = lambda rows: sorted(map(str, rows))
    want = c.execute(f"select page_id, host, path, rule, verdict from ({U.oracle()})").fetchall()
    assert key(tuple(r) for r in U.op1_url_filter(spark, sf).collect()) == key(want)


CASES = [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("example.com/en/x", "", "", None, "allow"), ("HTTP://Example.COM", "example.com", "", None, "allow"),
    ("http://example.com/en/a?b#c", "example.com", "/en/a", "example.com/en/", "block"), ("http://WWW.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/x", "a.www.example.com", "/en/x", "www.example.com/en/", "allow"), ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
    ("http://x.net/es/?q", "x.net", "/es/", "net/es/", "block"), ("http://x.net/es", "x.net", "/es", None, "allow"), ("http://x.org/porn/", "x.org", "/porn/", None, "block"),
    ("http://x.org/pornography", "x.org", "/pornography", None, "allow"), ("http://casino.org/bet", "casino.org", "/bet", None, "block"), ("http://casino.org/casino-casino", "casino.org", "/casino-casino", None, "allow"),
    ("http://x.org/éxxxé\nz", "x.org", "/éxxxé\nz", None, "block"), ("http://porn.com/", "porn.com", "/", "com/", "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://x.org/" + "a" * 100_000 + "/xxx", "x.org", "/" + "a" * 100_000 + "/xxx", None, "block"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], "old") for i, c in enumerate(CASES)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.url, r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df).collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case
    assert U.judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [{}, {"ab": 1, "abc": 1}])
def test_other_vocabularies(spark, weights):
    df = spark.createDataFrame([("h://x/ab-abc",), ("h://x/abc",)], "url string")
    got = [r.verdict for r in U.judge_urls(df, judge=U.UrlJudge(rules=(), weights=weights)).collect()]
    assert got == (["block", "allow"] if weights else ["allow", "allow"])


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Spam", 2), ("ham", 1), ("ham", 1), ("egg", 1), ("", 5), (None, 3), ("bad", 0)], "term string, weight int")
    weights = U.read_vocabulary(terms)
    assert weights == {"spam": 2, "ham": 1, "egg": 1}
    pages = spark.createDataFrame([(1, "http://a.org/SPAM"), (2, "http://a.org/ham/ham"), (3, "http://a.org/ham-egg"), (4, "http://a.org/spammer"), (5, "http://a.org/bad")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.score) for r in U.judge_urls(pages, judge=U.UrlJudge(rules=(), weights=weights)).collect()}
    assert got == {1: ("block", 2), 2: ("allow", 1), 3: ("block", 2), 4: ("allow", 0), 5: ("allow", 0)}
    with pytest.raises(ValueError):
        U.read_vocabulary(terms, limit=2)
