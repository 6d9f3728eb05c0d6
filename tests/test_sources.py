"""JSON in and out, file selection, catalogues, and indexes that are found again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ravelin.operators import retrieval as R
from ravelin.sources import json_io as J
from ravelin.streaming.refresh import rebuild_on_arrival


def put(path, content, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    if at:
        os.utime(path, (at, at))
    return str(path)


def test_loaders(spark, tmp_path):
    c = put(tmp_path / "c.json", {"source_file": "x.pdf", "chunks": [{"chunk_id": "a", "chunk_type": "text", "text": "t", "token_count": 1, "metadata": {"k": "v"}}, {"chunk_id": "b"}]})
    got = J.load_chunks(spark, c).orderBy("pos").collect()
    assert [(r.pos, r.chunk_id, r.text) for r in got] == [(0, "a", "t"), (1, "b", None)] and got[0].metadata == {"k": "v"}
    f = put(tmp_path / "f.json", {"metadata": {"source": "faq"}, "entries": [{"id": " 1 ", "question": "q", "answer": None}, None, {"id": "2"}]})
    assert [(r.faq_source, r.pos, r.id, r.question, r.answer) for r in J.load_faq(spark, f).orderBy("pos").collect()] == [("faq", 0, "1", "q", ""), ("faq", 2, "2", "", "")]
    q = put(tmp_path / "q.json", {"questions": [{"id": "1", "question": "w", "relevant_chunks": ["a", "b"], "expected_abstention": True}]})
    r = J.load_questions(spark, q).first()
    assert (r.id, r.question, r.relevant_chunks, r.expected_abstention) == ("1", "w", ["a", "b"], True)


def test_payloads(spark):
    size = lambda t: spark.range(1).select(F.size(J.faq_payload(F.lit(t))).alias("n")).first().n
    assert size('[{"id": 1}, 2]') == 2 and size('{"faqs": [1, 2, 3]}') == 3 and size('{"data": [1], "items": [1, 2]}') == 2
    with pytest.raises(Exception, match="no list of entries"):
        size('{"x": 1}')


def test_files(spark, tmp_path):
    put(tmp_path / "a" / "one_DOC.json", "{}", 100)
    put(tmp_path / "a" / "two_doc.json", "{}", 200)
    put(tmp_path / "b" / "three.json", "{}", 300)
    put(tmp_path / "b" / "z.pdf", "z")
    put(tmp_path / "b" / "y.pdf", "y")
    name = lambda p: p.rsplit("/", 1)[-1]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert name(J.resolved(spark, None, [str(tmp_path / "none"), a, b])) == "two_doc.json"
    assert name(J.resolved(spark, "three.json", [a, b])) == "three.json" and name(J.resolved(spark, None, [b], "*.pdf", by_name=True)) == "y.pdf"
    with pytest.raises(FileNotFoundError):
        J.resolved(spark, "four.json", [a, b])
    files, flags = J.newest_of_sources(spark, str(tmp_path), "doc", ["a", "b", "c"])
    assert [name(r.path) for r in files.collect()] == ["two_doc.json"] and sorted(json.loads(r.context)["source_type"] for r in flags.collect()) == ["b", "c"]
    assert {name(r.path) for r in J.newest(spark, str(tmp_path)).collect()} == {"two_doc.json", "three.json"}
    every = J.listing(spark, str(tmp_path), "*.json")
    assert J.marked_file(every, ["ONE"], ["two"]).first().name == "one_DOC.json" and J.marked_file(every, ["none"], ["doc"]).first().name == "three.json"


def test_catalogue(spark, tmp_path):
    put(tmp_path / "beta" / "raw" / "x.pdf", "x")
    put(tmp_path / "alpha" / "chunks" / "faq" / "x.json", "{}")
    put(tmp_path / "gamma" / "notes" / "x.txt", "x")
    got = J.catalogue(spark, str(tmp_path)).orderBy("document_id").collect()
    assert [(r.document_id, r.has_raw, r.has_chunks, r.is_default) for r in got] == [("alpha", False, True, True), ("beta", True, False, False)]


def test_persist(spark, tmp_path):
    for run in ("2024-01", "2024-02", "2024-03"):
        J.persist(spark.range(3), str(tmp_path), "out", run, keep=2)
    assert sorted(os.listdir(tmp_path / "out")) == ["2024-02", "2024-03"] and spark.read.json(str(tmp_path / "out" / "2024-03")).count() == 3


def test_scanned_chunks(spark, tmp_path):
    files = [("ok", {"chunks": [{"chunk_id": "a", "text": "one two"}, 7, {"chunk_id": "a", "text": "again"}, {"text": "x"}]}), ("bad", "{"), ("list", {"chunks": 3}), ("none", {"chunks": []})]
    df = spark.createDataFrame([(n, put(tmp_path / f"{n}.json", c)) for n, c in files], "source_type string, path string")
    rows, flags = J.scanned_chunks(spark, df)
    accepted, more = R.valid_chunks(rows)
    assert [(r.source_type, r.chunk_id, r.text) for r in accepted.collect()] == [("ok", "a", "one two")]
    assert sorted(r.code for r in flags.collect()) == ["CHUNK_RECORD_INVALID", "SOURCE_CHUNKS_INVALID", "SOURCE_FILE_READ_ERROR"] and sorted(r.code for r in more.collect()) == ["CHUNK_ID_DUPLICATE", "CHUNK_ID_MISSING"]
    assert {json.loads(r.context)["source_type"] for r in J.empty_sources(df, accepted).collect()} == {"bad", "list", "none"}


def test_stored_index_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "corpus")
    q = spark.createDataFrame([(1, "thesis")], "query_id int, text string")
    put_rows = lambda rows: spark.createDataFrame(rows, "chunk_id string, pos int, text string").coalesce(1).write.mode("overwrite").parquet(path)
    put_rows([("c1", 0, "The master thesis has 30 credits."), ("c2", 1, "Examination rules and grading policy."), ("c3", 2, "Study abroad in the third semester.")])
    corpus = spark.read.parquet(path)
    with pytest.raises(FileNotFoundError):
        R.stored_index(corpus, rebuild=False)
    for ix in (R.stored_index(corpus), R.stored_index(corpus, rebuild=False)):
        assert [(r.chunk_id, round(r.score, 6)) for r in R.bm25(q, ix).collect()] == [("c1", 0.497652)]
    put_rows([("c9", 0, "thesis thesis"), ("c8", 1, "rules"), ("c7", 2, "abroad")])
    fresh = spark.read.parquet(path)
    with pytest.raises(FileNotFoundError):
        R.stored_index(fresh, rebuild=False)
    assert [r.chunk_id for r in R.bm25(q, R.stored_index(fresh)).collect()] == ["c9"]
    near = R.dense(R.embedded(q).drop("text"), R.stored_vectors(fresh), 1).first()
    assert near.chunk_id == "c9" and near.score > 0.9


def test_rebuild_on_arrival(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    put(folder / "a.json", '{"chunk_id": "a"}\n{"chunk_id": "b"}')
    run = lambda: rebuild_on_arrival(spark, str(folder), "chunk_id string", lambda df: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(120)
    run()
    put(folder / "b.json", '{"chunk_id": "c"}')
    run()
    run()
    assert seen == [2, 3]
