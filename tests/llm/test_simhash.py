"""SimHash against brute force."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from genoloom.llm import simhash as S
from genoloom.llm.common import components


def brute_fp(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, radius):
    """fps: doc_id -> number."""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(fps, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= radius:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in fps}


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {d.doc_id: brute_fp(d.text) for d in docs}
    classes = brute_classes(fps, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op2_simhash_dedup(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", classes[i]) for i in fps}


@pytest.mark.parametrize(("n", "bits", "radius"), [(40, 64, 3), (200, 64, 3), (700, 64, 10), (300, 256, 60)])
def test_kernels(n, bits, radius):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 256, (max(1, n // 8), bits // 8), dtype=np.uint8)
    fps = base[rng.integers(0, len(base), n)]
    flips = rng.random((n, bits)) < radius / bits / 2
    fps = fps ^ np.packbits(flips, axis=1, bitorder="little")
    want = {(i, j) for i, j in itertools.combinations(range(n), 2) if np.unpackbits(fps[i] ^ fps[j]).sum() <= radius}
    assert want
    assert set(zip(*map(np.ndarray.tolist, S.block_links(fps, None, radius)), strict=True)) == want
    assert set(zip(*map(np.ndarray.tolist, S.near_links(np.zeros(n, int), fps, radius)), strict=True)) == want
    half = n // 2
    cross = {(i, j + half) for i, j in zip(*map(np.ndarray.tolist, S.block_links(fps[:half], fps[half:], radius)), strict=True)}
    assert cross == {(i, j) for i, j in want if i < half <= j}


@pytest.mark.parametrize(("n", "bits", "radius", "spread"), [(300, 64, 3, 0.02), (900, 64, 3, 0.005), (700, 256, 46, 0.12), (500, 64, 3, 0.06)])
def test_block_roots(n, bits, radius, spread):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 256, (3, bits // 8), dtype=np.uint8)
    fps = base[rng.integers(0, 3, n)] ^ np.packbits(rng.random((n, bits)) < spread, axis=1)
    for left in (n, n // 3):
        i, j = S.block_links(fps, None, radius) if left == n else S.block_links(fps[:left], fps[left:], radius)
        want = S.spanning(n, i, j if left == n else j + left)
        assert S.block_roots(fps, left, radius).tolist() == want.tolist()


@pytest.mark.parametrize("many", [False, True])
def test_tables_meet(many):
    tables = S.exact_tables(64, 3, many)
    rng = np.random.default_rng(1)
    for _ in range(500):
        wrong = set(rng.choice(64, 3, replace=False).tolist())
        assert any(not wrong & set(t.tolist()) for t in tables)


def test_large_blocks_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 16)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (3, 8), dtype=np.uint8)
    fps = {}
    for i in range(150):
        bits = np.unpackbits(base[i % 3])
        bits[rng.choice(20, 2, replace=False)] ^= 1
        fps[i] = np.packbits(bits).tobytes()
    signed = spark.createDataFrame([(i, bytearray(f)) for i, f in fps.items()], "doc_id long, fp binary")
    got = {r.doc_id: r.component_id for r in S.classes(signed, 3).collect()}
    assert got == brute_classes({i: int.from_bytes(f, "big") for i, f in fps.items()}, 3)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t\n", "z"), (4, "a b", None), (5, "A  B", "k"), (None, "a b", "k"), (7, "w " * 30000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit(9))
    signed = S.written(S.signatures(docs), "test")
    got = {r.doc_id: (bytes(r.fp).hex(), r.component_id) for r in S.classes(signed, 3).collect()}
    assert got[1] == got[2] == got[3] == ("0" * 16, 1)
    assert got[4][1] == got[5][1] == got[None][1] == 4
    assert got[4][0] == f"{xxhash.xxh64_intdigest(b'a b', 42):016x}"
    empty = S.written(S.signatures(docs.limit(0)), "test")
    assert S.classes(empty, 3).count() == 0


def test_near_duplicates_of_five_word_shingles(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    texts, family = [], []
    for k in range(60):
        base = list(rng.choice(words, 300))
        texts.append(" ".join(base))
        family.append(k)
        for _ in range(2):  # each changed word breaks five shingles: a similarity of 0.9 or so
            copy = base.copy()
            for at in rng.choice(300, 3, replace=False):
                copy[at] = "changed"
            texts.append(" ".join(copy))
            family.append(k)
    docs = spark.createDataFrame([(f"k{i}", i, t) for i, t in enumerate(texts)], "key string, doc_id long, text string")
    got = {r.doc_id: int(r.first_key[1:]) for r in S.near_duplicates(docs).collect()}
    right = sum(got[i] == min(j for j in range(len(texts)) if family[j] == family[i]) for i in got)
    assert right >= 0.98 * len(texts)
    assert all(family[i] == family[c] for i, c in got.items())


def jaccard(a, b):
    a, b = (set(S.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def classes_of(spark, texts):
    docs = spark.createDataFrame([(f"k{i}", i, t) for i, t in enumerate(texts)], "key string, doc_id long, text string")
    return {r.doc_id: int(r.first_key[1:]) for r in S.near_duplicates(docs).collect()}


@pytest.mark.parametrize("tile", [1 << 21, 100])
def test_near_duplicates_are_exact(spark, monkeypatch, tile):
    """Pairs at 0.6 to 0.79 stay apart and pairs at 0.8 or more are joined, short texts as long ones."""
    monkeypatch.setattr(S, "SET_TILE", tile, raising=False)
    rng = np.random.default_rng(11)
    texts, alike = [], []
    for n, extra in itertools.product([8, 9, 10, 12, 13, 20, 40, 80, 300], [1, 2, 3, 5, 8, 20, 60, 75, 110]):
        for _ in range(4):
            words = [f"w{x}" for x in rng.integers(0, 1 << 30, n + extra)]
            a, b = " ".join(words[:n]), " ".join(words)
            s = jaccard(a, b)
            if s >= 0.6:
                texts += [a, b]
                alike.append(s >= 0.8)
    assert 30 < sum(alike) < len(alike) - 30
    got = classes_of(spark, texts)
    joined = [got[2 * i + 1] == 2 * i for i in range(len(alike))]
    assert all(got[i] in (i, i - i % 2) for i in got)
    assert not any(j and not a for j, a in zip(joined, alike, strict=True))
    assert sum(j and a for j, a in zip(joined, alike, strict=True)) >= 0.97 * sum(alike)


def test_set_roots():
    rng = np.random.default_rng(2)
    base = [rng.choice(1000, 40, replace=False).astype(np.uint64) for _ in range(8)]
    sets = []
    for i in range(150):
        kept = rng.random(40) < (1 if i % 5 == 0 else 0.9)
        sets.append(np.unique(np.concatenate([base[i % 8][kept], rng.integers(2000, 9000, i % 4).astype(np.uint64)])))
    for left in (150, 60):
        pairs = [(i, j) for i, j in itertools.combinations(range(150), 2) if (left == 150 or i < left <= j)]
        ok = [(i, j) for i, j in pairs if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        want = S.spanning(150, *map(np.array, zip(*ok, strict=True)))
        assert S.set_roots(sets, left, 0.8).tolist() == want.tolist()


def test_near_duplicates_count_no_repeats(spark):
    rng = np.random.default_rng(13)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
    texts = []
    for _ in range(20):  # a line in common, repeated: the similarity is 0.1 or so
        line = fresh(20)
        texts += [" ".join(fresh(100) + line * 10), " ".join(fresh(100) + line * 10)]
    for _ in range(20):  # all shingles but one alike, repeated differently
        line, rest = fresh(20), fresh(300)
        texts += [" ".join(rest + line * 2), " ".join(rest + line * 200 + fresh(1))]
    got = classes_of(spark, texts)
    assert [got[i] for i in range(40)] == list(range(40))
    assert [got[i] for i in range(40, 80)] == [i - i % 2 for i in range(40, 80)]


def test_components_end_at_a_fixed_point(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    with pytest.raises(RuntimeError):
        components(path, max_rounds=1)
    assert {(r.node, r.root) for r in components(path).collect()} == {(i, 0) for i in range(1, 65)}


def test_hot_keys(spark, monkeypatch):
    """Chains through hubs, and joins whose keys are all hot, partly or not at all."""
    import genoloom.llm.common as C

    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500, i) for i in range(300, 420)] + [(i, 7) for i in range(600, 700)] + [(None, 3), (4, 4)]
    want = {}
    for a, b in pairs:
        if a is not None and a != b:
            x, y = want.setdefault(a, {a}), want.setdefault(b, {b})
            if x is not y:
                x |= y
                for i in y:
                    want[i] = x
    edges = spark.createDataFrame(pairs, "src long, dst long")
    left = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(100)] + [(9, 1)], "k long, v long")
    right = left.where("k < 9").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    plain = sorted(tuple(r) for r in left.join(right.drop("n"), "k").collect())
    for limit in (0, 20):
        monkeypatch.setattr(C, "HOT_ROWS", limit)
        monkeypatch.setattr(C, "HOT_KEYS", 10**9)
        assert {r.node: r.root for r in components(edges).collect()} == {i: min(s) for i, s in want.items() if i != min(s)}
        assert sorted(tuple(r) for r in C.join_by_key(left, right, "k", 101).collect()) == plain
