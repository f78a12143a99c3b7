"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Terms that reject a URL alone, and terms of which several distinct ones must meet.
STRICT_TERMS = (
    "bestiality", "botnet", "camgirl", "camgirls", "camwhore", "cardersforum", "crackz", "cumshot", "darkmarket", "ddos", "dumpz", "escortservice", "exploitkit", "fullz", "gangbang", "hentai", "keylogger", "malware",
    "milf", "nsfw", "phishing", "porn", "porno", "pornhub", "pornstar", "ransomware", "rape", "redtube", "rootkit", "serialz", "sexcam", "spyware", "stealer", "strippers", "trojan", "upskirt", "warez", "xhamster", "xnxx",
    "xvideos", "xxx", "youporn",
)
SOFT_TERMS = (
    "adult", "babes", "baccarat", "bet", "betting", "bingo", "blackjack", "bonus", "casino", "cheap", "cialis", "coupon", "crack", "cracked", "dating", "discount", "doubleup", "erotic", "escort", "fetish", "gambling", "hack",
    "hookup", "hot", "jackpot", "keygen", "kinky", "lingerie", "loan", "loans", "lottery", "lust", "naked", "nude", "nulled", "onlinepharmacy", "payday", "pharma", "pharmacy", "pills", "poker", "prescription", "proxy",
    "replica", "roulette", "seductive", "sex", "sexy", "singles", "slots", "sportsbook", "steroids", "swinger", "torrent", "unblocked", "viagra", "wager", "weightloss",
)
#: Terms of a vocabulary at most: every worker holds an automaton of them.
VOCABULARY_LIMIT = 1_000_000
THRESHOLD = 2

# Fixed values: (rule, verdict); a rule is host, slash, path prefix.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def vocabulary() -> dict[str, int]:
    """Weight of each term: a strict one reaches the threshold alone, soft ones count 1."""
    return {t: 1 for t in SOFT_TERMS} | {t: THRESHOLD for t in STRICT_TERMS}


def read_vocabulary(terms: DataFrame, limit: int = VOCABULARY_LIMIT) -> dict[str, int]:
    """Weights of terms (term, weight), of any table or file: A-Z lower-cased, the largest weight of a term counts; null or empty
    terms and weights that aren't above 0 are left out. More than `limit` terms raise."""
    rows = terms.select(F.translate("term", _UPPER, _LOWER).alias("term"), F.col("weight").cast("int").alias("weight")).where("term <> '' and weight > 0")
    held = rows.groupBy("term").agg(F.max("weight").alias("weight")).limit(limit + 1).collect()
    if len(held) > limit:
        raise ValueError(f"more than {limit} terms")
    return {r.term: r.weight for r in held}


@dataclass(frozen=True)
class UrlJudge:
    """Rules and vocabulary; one automaton per worker."""

    rules: Sequence[tuple[str, str]] = RULES
    weights: Mapping[str, int] | None = None
    threshold: int = THRESHOLD

    def prepare(self):
        import ahocorasick

        by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in self.rules:
            host, _, rest = rule.partition("/")
            by_host.setdefault(host, []).append(("/" + rest, rule, verdict))
        terms = ahocorasick.Automaton()
        for term, weight in (self.weights if self.weights is not None else vocabulary()).items():
            terms.add_word(term, (term, weight))
        if len(terms):
            terms.make_automaton()
        return by_host, terms

    @staticmethod
    def rule(by_host, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits (a tie goes to the longer host), and its verdict."""
        best, rest = (0, 0, None, None), host
        while by_host:
            for prefix, rule, verdict in by_host.get(rest, ()):
                if path.startswith(prefix) and (len(rule), len(rest)) > best[:2]:
                    best = (len(rule), len(rest), rule, verdict)
            _, dot, rest = rest.partition(".")
            if not dot:
                break
        return best[2], best[3]

    @staticmethod
    def score(terms, url: str) -> int:
        """Summed weight of the distinct terms that stand between boundaries (no ASCII letter or digit)."""
        if not len(terms):
            return 0
        found, n = {}, len(url)
        inner = lambda c: c.isascii() and c.isalnum()
        for end, (term, weight) in terms.iter(url):
            start = end - len(term)
            if (start < 0 or not inner(url[start])) and (end + 1 == n or not inner(url[end + 1])):
                found[term] = weight
        return sum(found.values())


def judge_urls(df: DataFrame, url: str = "url", judge: UrlJudge | None = None) -> DataFrame:
    """df with host, path, rule, verdict and score of each URL.

    A null URL or one without "://" has an empty host and path; a null URL scores 0. Without a rule that fits, the
    URL is blocked if its score reaches the threshold. Columns of df with those names are replaced. Rows never meet,
    so ties, repeats and an empty table need no rule. There is no shuffle.
    """
    judge = judge or UrlJudge()
    lower = lambda c: F.translate(c, _UPPER, _LOWER)
    whole = F.coalesce(F.col(f"`{url}`"), F.lit(""))

    @F.pandas_udf("rule string, verdict string, score int")
    def decide(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        by_host, terms = judge.prepare()
        for urls, hosts, paths in parts:
            rows = []
            for u, h, p in zip(urls, hosts, paths, strict=True):
                score = judge.score(terms, u)
                rule, verdict = judge.rule(by_host, h, p)
                rows.append((rule, verdict or ("block" if score >= judge.threshold else "allow"), score))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "score"])

    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "score")]
    host, path = lower(F.regexp_extract(whole, _URL, 1)), F.regexp_extract(whole, _URL, 2)
    found = df.select(*(F.col(f"`{c}`") for c in kept), host.alias("host"), path.alias("path"), decide(lower(whole), host, path).alias("_judged"))
    return found.select(*(F.col(f"`{c}`") for c in kept), "host", "path", "_judged.rule", "_judged.verdict", "_judged.score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """The same rows by regular expressions, one per term."""
    terms = " + ".join(f"{w} * cast(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as int)" for t, w in vocabulary().items())
    fits = sorted(RULES, key=lambda r: -len(r[0]))
    when = lambda r: f"(host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}')"
    rule = "case " + " ".join(f"when {when(r)} then '{r}'" for r, _ in fits) + " end"
    verdict = "case " + " ".join(f"when rule = '{r}' then '{v}'" for r, v in fits)
    return f"""
    with split as (
      select page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') as low,
        translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(url, '{_URL}', 2), '') as path
      from pages),
    ruled as (select *, {rule} as rule, {terms} as score from split)
    select page_id, host, path, rule, {verdict} when score >= {THRESHOLD} then 'block' else 'allow' end as verdict from ruled"""
