"""Near-duplicates by MinHash and odd sketches against comparing all pairs of sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import minhash
from ravelin.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def by_hand(rows):
    """(doc_id, n, component, kept) of rows (doc_id, text), whose repeated ids are one document; rows without an id only follow."""
    sets = [shingle_set(t) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def unite(x, y):
        x, y = sorted((root(x), root(y)))
        up[y] = x

    least = {}
    for (i, _), s in zip(rows, sets):
        if i is not None and s:
            unite(i, least.setdefault(s, i))
    distinct = list(least)
    for x in range(len(distinct)):
        for y in range(x):
            a, b = distinct[x], distinct[y]
            if 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                unite(least[a], least[b])
    out = []
    for (i, _), s in zip(rows, sets):
        c = root(i) if i is not None else root(least[s]) if s in least else None
        out.append((i, len(s), c, i is not None and i == c))
    return out


def same(df, expected):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=key) == sorted(expected, key=key)


def text(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(rng, words, k):
    out = list(words)
    for at in rng.sample(range(len(out)), k):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def test_awkward_rows(spark):
    rng = random.Random(3)
    base = text(rng, 60)
    texts = [None, "", " \n", "a", "A", "a b c", "a b c d", "a b c d e", "a b c d e f", "a b c d a b c d a b c d", " ".join(base), " ".join(base).upper(), "\t".join(base) + "\n", " ".join(base) + " tail", " ".join(edited(rng, base, 1)), " ".join(edited(rng, base, 9)), "x " * 30_000, "x " * 50, "é É ÿ ß 日本 😀 x", "é é ÿ ß 日本 😀 x", " ".join(text(rng, 30_000))]
    rows = [(i + 3, t) for i, t in enumerate(texts)] + [(None, " ".join(base)), (None, "lone text of nobody else here"), (None, None), (40, " ".join(text(rng, 20))), (40, " ".join(base[:50])), (40, "a b c"), (41, "solo one two three"), (41, "other four five six")]
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n int, label string, id int").repartition(3)
    same(minhash.groups(docs), by_hand(rows))


def test_empty_table(spark):
    assert minhash.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("block", [512, 8, 3])
def test_families(spark, monkeypatch, block):
    """Families of near copies on both sides of the threshold, in one block and in many."""
    rng = random.Random(9)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    rows = []
    for size, n, most in ((40, 200, 8), (40, 120, 6), (60, 60, 5), (30, 400, 14)):
        base = text(rng, n)
        near = [edited(rng, base, rng.randint(0, most)) for _ in range(size)]
        near += [edited(rng, x, rng.randint(1, 3)) for x in near[::3]]
        rows += [" ".join(x) for x in near]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    expected = by_hand(rows)
    assert 4 < len({c for _, _, c, _ in expected}) < len(rows) - 20
    same(minhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), expected)


def test_no_link_is_lost():
    """Pairs at the threshold and closer share a key and pass the sketches' limit."""
    rng = np.random.default_rng(4)
    limit, pairs = minhash.odd_limit(0.8), 0
    for n in (4, 9, 18, 45, 180, 900):
        for _ in range(150):
            both = -(-8 * n // 10)
            h = rng.integers(0, 1 << 63, n + n - both, dtype=np.uint64)
            a, b = h[: both + (n - both) // 2], np.concatenate([h[:both], h[both + (n - both) // 2 : n]])
            assert 100 * both >= 80 * n
            x, y = minhash.samples(a), minhash.samples(b)
            assert (minhash.band_keys(x) == minhash.band_keys(y)).any()
            assert np.bitwise_count(np.frombuffer(minhash.odd_sketch(x), np.uint64) ^ np.frombuffer(minhash.odd_sketch(y), np.uint64)).sum() <= limit
            pairs += 1
    assert pairs == 900
    far = [minhash.odd_sketch(minhash.samples(rng.integers(0, 1 << 63, 100, dtype=np.uint64))) for _ in range(20)]
    assert all(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum() > limit for i, a in enumerate(far) for b in far[:i])


def test_sketch_estimates_similarity():
    """The population count of the exclusive or follows from the similarity, closely above a half."""
    rng = np.random.default_rng(5)
    for share in (0.6, 0.8, 0.95):
        got = []
        for _ in range(60):
            h = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            k = int(1000 * share)
            a, b = np.concatenate([h[:k], h[k : k + (1000 - k) // 2]]), np.concatenate([h[:k], h[k + (1000 - k) // 2 :]])
            z = np.bitwise_count(np.frombuffer(minhash.odd_sketch(minhash.samples(a)), np.uint64) ^ np.frombuffer(minhash.odd_sketch(minhash.samples(b)), np.uint64)).sum()
            got.append(1 + minhash.BITS * np.log(1 - 2 * z / minhash.BITS) / (4 * minhash.SAMPLES))
        assert abs(np.mean(got) - share) < 0.02


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(QUERIES["op11_minhash"](spark, SF).select("doc_id", "n_shingles", "component_id", F.col("kept")), by_hand(rows))
