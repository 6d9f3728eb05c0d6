"""Spelling variants against comparing all pairs."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import spelling
from ravelin.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(rows, every=97, min_chars=5, min_count=3):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def left_out(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return a in left_out(b) or b in left_out(a)


def by_hand(n, ratio=2):
    spots = collections.defaultdict(set)  # what is left when a place is left out
    for w in n:
        spots[w].add(w)
        for x in left_out(w):
            spots[x].add(w)
    near = collections.defaultdict(set)
    for group in spots.values():
        for a in group:
            near[a] |= {b for b in group if a != b and is_near(a, b)}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def same(df, expected):
    assert sorted(tuple(r) for r in df.select(*COLUMNS).collect()) == expected


def awkward():
    rng = random.Random(5)
    dense = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 8))) for _ in range(400)]
    texts = [None, "", " ", "12 34 !?", "ÀÉÎÕÜß×÷ÿ àéîõüß " * 3, "straße Straße STRASSE strase " * 3, "word日本語word😀words wordyĀwords", "aaaaa aaaa aaaaaa aaaaaaa aaaab " * 4, "x" * 40_000 + " " + "x" * 40_000, ("x" * 39_999 + " ") * 3, " ".join(dense), " ".join(dense), " ".join(dense[::2]), "Colour color colours colors colour " * 5]
    return [(i, t, "w", 1) for i, t in enumerate(texts)] + [(None, "Colour colr " * 4, "w", 2), (3, "colour colour colours", "w", 3), (3, "colour colour colours", "w", 3)]


@pytest.mark.parametrize(("every", "key_rows"), [(97, 20_000), (3, 4), (1, 20_000)])
def test_awkward_rows(spark, every, key_rows):
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.group(docs, every=every, key_rows=key_rows)
    same(got, by_hand(vocabulary([r[:2] for r in rows], every)))


def test_split_keys(spark):
    """Keys that too many words share are split until a key has one place; no pair is lost or found twice."""
    rng = random.Random(8)
    found = {"front" + "".join(rng.choice("abc") for _ in range(6)) + "back" for _ in range(300)} | {"front" + "".join(rng.choice("abc") for _ in range(5)) + "back" for _ in range(100)}
    rows = [(w.encode(), rng.randint(3, 9)) for w in sorted(found)]
    words = spark.createDataFrame(rows, "word binary, n long")
    keys = spelling.dealt(words, 40).groupBy("key").count().join(spelling.dealt(words, 40).selectExpr("key", "last - first as places").distinct(), "key").collect()
    assert all(r["count"] <= 40 or r.places == 1 for r in keys)
    expected = sorted((a, b) for a in found for b in found if a != b and is_near(a, b))
    for limit in (40, 1, 10**6):
        assert sorted((bytes(r.word).decode(), bytes(r.other).decode()) for r in spelling.pairs(words, limit).collect()) == expected


def test_empty_table(spark):
    assert spelling.group(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "abcdefgh ijk lmnopqrstuvwxyz Äöü äöüßx, abcdef"
    assert [r for x in spelling._pieces(text) for r in spelling.LETTERS.findall(x)] == [x.encode("latin-1") for x in re.findall("[a-zÀ-ÿ]+", text.translate(LOW))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 40)] * 4), max_size=8), st.integers(1, 40), st.randoms(use_true_random=False))
def test_wavelet(ranges, n, rng):
    values = list(range(n))
    rng.shuffle(values)
    a, b, c, d = (np.array([r[i] for r in ranges], np.int64).clip(0, n) for i in range(4))
    got = sorted(zip(*(x.tolist() for x in spelling.Wavelet(np.array(values)).report(a, b, c, d))))
    assert got == sorted((q, v) for q in range(len(ranges)) for v in values[a[q] : b[q]] if c[q] <= v < d[q])


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(bytes([97 + i]), bytes([98 + i])) for i in range(20)], "word binary, form binary")
    assert {bytes(r.root) for r in spelling.roots(forms).collect()} == {bytes([97 + 20])}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(QUERIES["op12_spelling"](spark, SF), by_hand(vocabulary(rows)))
