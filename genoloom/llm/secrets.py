"""Secret scan by DataFrame functions alone: three patterns, and two character Markov models compared on what they leave.

A Markov model counts the transitions of characters in labelled samples. A candidate's score is the mean, over its
transitions, of the logarithm of the likelihood under the model of random strings over that under ordinary identifiers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Kinds in their order, pattern, group whose length counts, least length. A run of access or hex characters
# that is too short fails as a whole, so its least length stands in the pattern and short runs aren't matches to look at.
BASE = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
MARKOV = "markov"
#: Candidates of the Markov models: runs of these with a letter and a digit.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Mean log-likelihood ratio from which a candidate is a secret.
THRESHOLD = 0.35

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIDE = len(_ALPHABET) + 1
_MARK, _OTHER = "\u0001", "\u0002"

# Words of which the ordinary identifiers of the samples are made.
_WORDS = """account action address amount article author background balance banner basket block border branch bucket button cache
category channel client cluster color column comment config content context control count country customer data database date default
detail device direct display document domain download driver editor element email engine entry error event example export factory field file
filter folder font format frame function gallery group handler header height history image import index info input instance invoice item
language latest layout left length level library light limit line link list local location login logger manager map margin member memory menu
message method model module month mouse name network node number object offset option order output package page panel parent parser path
payment person phone picture player point policy position price product profile project property query queue random range read record region
release report request result right root route sample schema screen script search section select sender server service session setting shadow
shape simple size source stage start state status stock storage store stream string style submit summary switch system table target task team
template test text theme thread time title toggle total track transfer type update upload user value vector version view visit width window write
year zone""".split()


def samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled samples (random boolean, token), 4 n of each label, made by rule from digests of their number.

    Random: hexadecimal, base 64, upper-case and lower-case alphanumeric strings. Ordinary: words joined by underscore,
    hyphen, slash or camel case, with numbers, dates or versions among them.
    """
    pool = F.array(*(F.lit(w) for w in _WORDS))
    word = lambda k: F.element_at(pool, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(_WORDS))) + 1).cast("int"))
    number = lambda k, m: F.pmod(F.xxhash64("id", F.lit(100 + k)), F.lit(m)).cast("string")
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    ids = spark.range(n)
    random = F.array(
        F.substring(digest, 1, 40),
        F.substring(b64, 1, 40),
        F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 20)),
        F.lower(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 24)),
    )
    ordinary = F.array(
        F.concat_ws("_", word(1), word(2), word(3), number(1, 100)),
        F.concat(word(4), F.initcap(word(5)), F.initcap(word(6)), F.initcap(word(7)), number(2, 10)),
        F.concat_ws("-", word(8), word(9), F.concat(F.lit("20"), F.lpad(number(3, 30), 2, "0")), F.lpad(number(4, 12), 2, "0"), F.lpad(number(5, 28), 2, "0")),
        F.concat_ws("/", word(10), F.concat(F.lit("v"), number(6, 9)), F.concat_ws("_", word(11), word(12)), number(7, 10000)),
    )
    return ids.select(F.lit(True).alias("random"), F.explode(random).alias("token")).union(ids.select(F.lit(False), F.explode(ordinary)))


def train(labelled: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each transition (flat, alphabet by alphabet) from labelled samples (random, token).

    Transitions are counted by one aggregation; its result, bounded by the square of the alphabet, goes to the driver.
    Null tokens and labels are ignored.
    """
    steps = labelled.where("token is not null and random is not null and length(token) > 1").select("random", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"), "token")
    code = lambda at: F.instr(F.lit(_ALPHABET), F.substring("token", at, 1))
    counts = {(r.random, r.a, r.b): r["count"] for r in steps.select("random", code(F.col("i")).alias("a"), code(F.col("i") + 1).alias("b")).groupBy("random", "a", "b").count().collect()}
    rows = {(label, a): sum(counts.get((label, a, b), 0) for b in range(_SIDE)) for label in (True, False) for a in range(_SIDE)}

    def log_p(label: bool, a: int, b: int) -> float:
        return math.log((counts.get((label, a, b), 0) + smoothing) / (rows[label, a] + smoothing * _SIDE))

    return [log_p(True, a, b) - log_p(False, a, b) for a in range(_SIDE) for b in range(_SIDE)]


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio over the transitions of a token of two characters or more."""
    lookup = F.split(F.lit(",".join(repr(r) for r in ratios)), ",").cast("array<double>")  # folded to one literal
    code = lambda at: F.instr(F.lit(_ALPHABET), F.substring(token, at, 1))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(lookup, code(i) * _SIDE + code(i + 1) + 1))
    return total / (F.length(token) - 1)


def _scan(values: Column, merge, empty: Column) -> Column:
    """merge over each element and all before it, in as many rounds as the length has binary digits."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(steps, values, lambda held, step: F.transform(held, lambda x, i: merge(x, F.coalesce(F.get(held, i - step), empty))))


def _spans(marked: Column, kind: str, order: int, keep) -> Column:
    """Spans array<struct<start,rank,end,kind>> of the matches that stand between marks, in code points."""
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    parts = F.split(marked, _MARK)
    ends = _scan(F.transform(parts, lambda p: F.char_length(p)), lambda a, b: a + b, F.lit(0))

    def span(both: Column, i: Column) -> Column:
        made = F.struct((both["end"] - F.char_length(both["part"])).alias("start"), F.lit(order).alias("rank"), both["end"].alias("end"), F.lit(kind).alias("kind"))
        return F.when((i % 2 == 1) & keep(both["part"]), made)

    found = F.filter(F.transform(F.arrays_zip(parts.alias("part"), ends.alias("end")), span), lambda x: x.isNotNull())
    return F.when(F.instr(marked, _MARK) > 0, found).otherwise(none)


def _touching(spans: Column) -> Column:
    """Of sorted spans those of the models that touch no base span, and the base spans: base spans that begin before
    one end by the largest end so far, and those that begin inside it by the least start to come."""
    base = len(BASE)
    last = F.lit(2**31 - 1)
    ended = _scan(F.transform(spans, lambda s: F.when(s["rank"] < base, s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0))
    ahead = F.reverse(_scan(F.transform(F.reverse(spans), lambda s: F.when(s["rank"] < base, s["start"]).otherwise(last)), lambda a, b: F.least(a, b), last))
    zipped = F.arrays_zip(spans.alias("span"), ended.alias("ended"), ahead.alias("ahead"))
    return F.transform(F.filter(zipped, lambda z: (z["span"]["rank"] < base) | ((z["ended"] <= z["span"]["start"]) & (z["ahead"] >= z["span"]["end"]))), lambda z: z["span"])


def find_secrets(docs: DataFrame, ratios: list[float] | None = None, text: str = "text") -> DataFrame:
    """docs with `secrets`: array<struct<start,rank,end,kind>>, by start, then kind as listed; offsets are code points.

    The base kinds are matched leftmost and without overlap within a kind, over the whole text, and kept if long
    enough. The Markov models add candidates that touch no base span. A null text is empty and has none. Rows never
    meet, so there is no shuffle; a column named secrets is replaced.
    """
    ratios = train(samples(docs.sparkSession)) if ratios is None else ratios
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "secrets"]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    clean = F.when(F.instr(whole, _MARK) > 0, F.translate(whole, _MARK, _OTHER)).otherwise(whole)
    with_clean = docs.select(*kept, clean.alias("_clean"))
    kinds = [*BASE, (MARKOV, CANDIDATE, 0, 0)]
    marked = with_clean.select(*kept, *(F.regexp_replace("_clean", f"(?:{p})" if k != "assign" else p, f"{_MARK}$0{_MARK}").alias(f"_{k}") for k, p, _, _ in kinds))

    def long_enough(pattern: str, group: int, least: int):
        return lambda part: F.length(F.regexp_extract(part, pattern, group) if group else part) >= least

    def random_string(part: Column) -> Column:
        return part.rlike("[0-9]") & part.rlike("[A-Za-z]") & (mean_ratio(part, ratios) >= THRESHOLD)

    found = [_spans(F.col(f"_{k}"), k, n, long_enough(p, g, least)).alias(f"_{k}") for n, (k, p, g, least) in enumerate(BASE)]
    spans = marked.select(*kept, *found, _spans(F.col(f"_{MARKOV}"), MARKOV, len(BASE), random_string).alias(f"_{MARKOV}"))
    joined = spans.select(*kept, F.array_sort(F.concat(*(F.col(f"_{k}") for k, *_ in BASE), F.col(f"_{MARKOV}"))).alias("_all"), (F.size(f"_{MARKOV}") > 0).alias("_more"))
    return joined.select(*kept, F.when(F.col("_more") & F.exists("_all", lambda s: s["rank"] < len(BASE)), _touching(F.col("_all"))).otherwise(F.col("_all")).alias("secrets"))


def redact(found: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """found (of find_secrets) with every span of text replaced by the mask, overlapping spans by one; without `secrets`."""
    whole = F.col(f"`{text}`")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("secrets", first, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.char_length(whole))))
    return found.withColumn(text, F.when(F.size("secrets") > 0, done).otherwise(whole)).drop("secrets")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *(count(k) for k, *_ in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
