"""The fill-in-the-middle transformation against plain slicing."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.llm import fim
from ravelin.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def by_hand(doc_id, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(b"7:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if text == "" or re.search("<[PSM]>", text):
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_awkward_rows(spark):
    texts = [None, "", "\n", "\n\n\n", "a", "a\nb", "a\r\nb\x0bc d\x85e\n", "x <P> y\nz", "<S", "<\nS><\n>", "日本語😀\né\u0000\n", "line\n" * 50_000, "z" * 300_000, "same\ntext\n", "same\ntext\n"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no\nid\n", "c", 2), (5, "again\nid\nfive\n", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    got = fim.apply(docs, ("n", "form", "prefix_chars", "middle_chars", "output", "restored", "output_sha256"))
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    expected = []
    for i, t, *_ in rows:
        made = by_hand(i, t or "")
        expected.append((i, *made, t or "", hashlib.sha256(made[-1].encode()).hexdigest()))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected, key=key)
    back = fim.restore(got.select("doc_id", "output", "form", F.lit(1).alias("text")))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t, *_ in rows)


def test_empty_table(spark):
    assert fim.apply(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rates(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    forms = {r.form: r["count"] for r in fim.apply(docs, ("form",), rate=60, spm_rate=25).groupBy("form").count().collect()}
    assert 120 < forms["plain"] < 200 and forms["spm"] < forms["psm"]
    with pytest.raises(ValueError):
        fim.apply(docs, sentinels=("<P>", "<S>", "><"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n<>PSMé😀", max_size=60), st.tuples(*[st.integers(0, 2**32 - 1)] * 4), st.integers(1, 7))
def test_rope(text, numbers, leaf):
    whole = fim.rope(text, leaf)
    assert (whole.units, whole.chars, fim.written(whole)) == (text.count("\n"), len(text), text)
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    for k in range(len(lines) + 2):
        assert [fim.written(x) for x in fim.split(whole, k, "units")] == ["".join(lines[:k]), "".join(lines[k:])]
    for k in range(len(text) + 2):
        assert [fim.written(x) for x in fim.split(whole, k, "chars")] == [text[:k], text[k:]]
    _, form, _, _, out = fim.transformed(text, numbers)
    assert fim.restored(out, form) == text


def test_query(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        made = by_hand(r.doc_id, r.text or "")
        expected.append((r.doc_id, *made[:-1], sha(made[-1]), sha(r.text or "")))
    assert sorted(tuple(r) for r in QUERIES["op13_fim"](spark, SF).collect()) == sorted(expected)
