"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order; each model sees the words of a text and the probabilities of the categories before
it. While training, those probabilities are out-of-fold predictions, so that a later model learns from
earlier ones as they will be on texts that they haven't seen. The chain ends with toxicity as such.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_texts, written

#: Labelled rows of each class on which the chain is fitted, at most; chosen by the hash of their id.
SAMPLE = 1500
#: Bytes of their texts, at most; a text that would go beyond is passed over.
SAMPLE_BYTES = 32 << 20
#: Word features of the models, at most.
FEATURES = 800
FOLDS = 3
SEED = 3
#: Lengths of word beginnings that are features beside whole words.
PREFIXES = (3, 4, 5)
#: How many clean texts wrongly rejected weigh as much as one toxic text missed, when the threshold is set.
CAUTION = 5.0


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, code) of every distinct word of each text, and the words by code: runs of letters in lower case."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}]+")
    coded = lists.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    words = coded.dictionary.to_pylist()
    pairs = np.unique(text * max(1, len(words)) + coded.indices.to_numpy())
    return pairs // max(1, len(words)), pairs % max(1, len(words)), words


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a hyphen)."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)] if word else []


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Weights, the intercept last, by accelerated gradient descent with classes weighted alike."""
    x = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float32)
    share = y.mean()
    if share in (0, 1):
        return np.append(np.zeros(x.shape[1] - 1), 20.0 if share else -20.0)
    y = y.astype(np.float32)  # single precision throughout: no copy of x
    weight = (np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)).astype(np.float32)
    step = 4.0 / max(1e-9, float((weight * (x * x).sum(axis=1)).sum()))
    now = ahead = np.zeros(x.shape[1], np.float32)
    shrink = np.append(np.full(x.shape[1] - 1, penalty, np.float32), np.float32(0))
    for t in range(rounds):
        slope = x.T @ (weight * (_sigmoid(x @ ahead) - y)) + shrink * ahead
        following = ahead - np.float32(step) * slope
        ahead = following + np.float32(t / (t + 3)) * (following - now)
        now = following
    return now


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    """Fitted models in their order: words, then for each category its weights over words and earlier categories."""

    categories: list[str]
    words: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 1.0

    def matrix(self, texts: pa.Array) -> np.ndarray:
        """Presence of each feature in each text."""
        text, code, words = word_lists(texts)
        owned = [[self.words[f] for f in features_of(w) if f in self.words] for w in words]
        out = np.zeros((len(texts), len(self.words)), np.float32)
        has = np.array([bool(o) for o in owned], bool)
        if len(code):
            keep = has[code]
            for t, c in zip(text[keep].tolist(), code[keep].tolist(), strict=True):
                out[t, owned[c]] = 1
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (texts, categories)."""
        out = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            out = np.column_stack([out, _sigmoid(np.column_stack([x, out]) @ w[:-1] + w[-1])])
        return out


def select_features(texts: pa.Array, toxic: np.ndarray, most: int = FEATURES) -> list[str]:
    """Words and beginnings that toxic texts have more often, by the chi-square of their presence."""
    numbers: dict[str, int] = {}
    have, both, at = np.zeros(0), np.zeros(0), 0
    while at < len(texts):  # a few hundred texts at a time
        text, code, words = word_lists(texts.slice(at, 250))
        owned = [[numbers.setdefault(f, len(numbers)) for f in features_of(w)] for w in words]
        sizes = np.array([len(o) for o in owned], np.int64)
        flat, starts = np.array([f for o in owned for f in o], np.int64), np.cumsum(sizes) - sizes
        each = sizes[code]
        inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        pairs = np.unique(np.repeat(text, each) * len(numbers) + flat[np.repeat(starts[code], each) + inside]) if len(flat) else np.zeros(0, np.int64)
        of, which = pairs % max(1, len(numbers)), pairs // max(1, len(numbers)) + at
        grown = np.zeros(len(numbers) - len(have))
        have = np.append(have, grown) + np.bincount(of, minlength=len(numbers))
        both = np.append(both, grown) + np.bincount(of, weights=toxic[which], minlength=len(numbers))
        at += 250
    n, positive = len(toxic), float(toxic.sum())
    expected = have * positive / n
    more = (have >= 4) & (both / max(1.0, positive) > 2 * (have - both) / max(1.0, n - positive))
    score = np.where(more, (both - expected) ** 2 / np.maximum(expected, 1e-9), -1.0)
    names = list(numbers)
    best = sorted(np.flatnonzero(more).tolist(), key=lambda i: (-score[i], names[i]))
    return [names[i] for i in best[:most]]


def fit(texts: pa.Array, labels: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """A chain over labels (category -> 0 or 1 of each text), in their order, of which the last is toxicity as such."""
    names = list(labels)
    last = np.asarray(labels[names[-1]], float)
    chain = Chain(names)
    if not len(texts) or not last.any():
        chain.weights = [np.append(np.zeros(k), -20.0) for k in range(len(names))]
        return chain
    chain.words = {f: i for i, f in enumerate(select_features(texts, last))}
    x = np.concatenate([chain.matrix(texts.slice(at, 250)) for at in range(0, len(texts), 250)])
    fold = np.random.default_rng(SEED).permutation(len(x)) % folds
    before = np.zeros((len(x), 0), np.float32)
    for name in names:
        y, own = np.asarray(labels[name], float), np.column_stack([x, before])
        out = np.zeros(len(x), np.float32)
        for k in range(folds):  # out-of-fold probabilities feed the models after this one
            w = _logistic(own[fold != k], y[fold != k])
            out[fold == k] = _sigmoid(own[fold == k] @ w[:-1] + w[-1])
        chain.weights.append(_logistic(own, y))
        before = np.column_stack([before, out])
    # the threshold, by the last category's out-of-fold probabilities
    held = before[:, -1]
    tried = np.unique(np.concatenate([np.linspace(0.05, 0.95, 91), [0.5]]))
    loss = [((held < t) & (last > 0)).sum() / max(1, last.sum()) + CAUTION * ((held >= t) & (last == 0)).sum() / max(1, (1 - last).sum()) for t in tried]
    best = np.flatnonzero(np.isclose(loss, min(loss)))
    chain.threshold = float(min(tried[best], key=lambda t: abs(t - 0.5)))
    return chain


def _sample(docs: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """doc_id, lang, text and labels of at most `sample` ids of each class and SAMPLE_BYTES, chosen in the order of the ids' hashes: one row an id."""
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).union(known.where("toxic = 0").orderBy(*order).limit(sample))
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    found = docs.select("doc_id", lang.alias("lang"), "text").join(F.broadcast(chosen), "doc_id").where("text is not null")  # 2 * sample ids at most
    rows = found.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"), "lang", "text", *(c for c in chosen.columns if c != "doc_id"))
    # of several texts of an id the shortest counts; their lengths come to the driver, no text does
    each = [c for c in rows.columns if c != "doc_id"]
    one = written(rows.groupBy("doc_id").agg(F.min(F.struct(*each)).alias("m")).select("doc_id", "m.*"), "labelled")
    fits, total = [], 0
    for r in one.select("doc_id", "size", F.xxhash64("doc_id").alias("turn")).orderBy("turn", "doc_id").collect():
        if total + r["size"] <= SAMPLE_BYTES:
            total += r["size"]
            fits.append((r.doc_id,))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(fits, one.select("doc_id").schema))
    return one.join(wanted, "doc_id").drop("size", "h")


def _sampled(docs: DataFrame, known: DataFrame, sample: int) -> pa.Table:
    """The rows of _sample by doc_id."""
    return _sample(docs, known, sample).toArrow().sort_by("doc_id")


def _fitted(held: pa.Table | None, own: list[str], languages: int) -> Chain:
    """The chain of a sample; own: its categories but the last, in the columns _is_0, _is_1, ..."""
    if held is None or not held.num_rows:
        return fit(pa.array([], pa.string()), dict.fromkeys([*own, "toxic"], np.zeros(0)))
    toxic, text = held["toxic"].to_numpy().astype(float), held["text"].combine_chunks()
    if own:
        return fit(text, {c: held[f"_is_{n}"].to_numpy().astype(float) for n, c in enumerate(own)} | {"toxic": toxic})
    lang = np.array(held["lang"].to_pylist(), object)
    names, counts = np.unique(lang[toxic > 0].astype(str), return_counts=True)
    used = [str(n) for n in names[np.argsort(-counts, kind="stable")][:languages] if n]
    return fit(text, {f"toxic_{n}": toxic * (lang == n) for n in used} | {"toxic": toxic})


def fit_labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, languages: int = 4) -> Chain:
    """The chain of labelled documents, whose last category is toxicity as such.

    Columns of labels other than doc_id, quality and toxic are its earlier categories, in their order (0 or 1; null counts as
    0). Without such columns they are toxicity in each of the most frequent languages. Of each class (toxic or not) the
    `sample` labelled ids of the smallest hash are used, so the fit is bounded in rows and bytes however often an id is
    repeated, and one task does it; a doc_id labelled more than once counts as toxic if any label says so. Null labels, ids and texts are left out.
    """
    own = [c for c in labels.columns if c not in ("doc_id", "quality", "toxic")]
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), *(F.coalesce(F.max(F.col(f"`{c}`").cast("int")), F.lit(0)).alias(f"_is_{n}") for n, c in enumerate(own)))
    rows = _sample(docs, known, sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        chain = _fitted(pa.Table.from_batches(held).sort_by("doc_id") if held else None, own, languages)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], ["chain"])

    # one task holds the sample, and the driver only the chain: what it holds once, its Python keeps
    made = rows.repartition(1).mapInArrow(work, "chain binary").first()
    return pickle.loads(made.chain) if made else _fitted(None, own, languages)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with `categories` (map of category to probability), `p_toxic` and `rejected`, columns of those names replaced.

    A null or empty text has no words: its probability is the models' intercept. Whole texts are read; rows never
    meet, so repeats and ties need no rule, and there is no shuffle.
    """
    docs = whole_texts(docs).drop("categories", "p_toxic", "rejected")
    columns, text_at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by FEATURES

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                p = chain.predict(chain.matrix(batch.column(text_at)))
                maps = pa.array([list(zip(chain.categories, row, strict=True)) for row in p.tolist()], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, maps, pa.array(p[:, -1].astype(float)), pa.array(p[:, -1] >= chain.threshold)], [*columns, "categories", "p_toxic", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(judge, f"{schema}, categories map<string,double>, p_toxic double, rejected boolean")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being toxic, and whether it is rejected; the models' own probabilities beside it."""
    docs = table(spark, sf_dir, "documents")
    chain = fit_labelled(docs, table(spark, sf_dir, "labels"))
    found = score(docs.select("doc_id", "text"), chain)
    return found.select("doc_id", F.round("p_toxic", 6).alias("p_toxic"), F.col("rejected").alias("toxic"))
