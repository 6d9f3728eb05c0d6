"""Hybrid search with failing backends and hits that are none."""

import json

import pytest
from pyspark.sql import functions as F

from ravelin.operators import backends as B
from ravelin.operators import retrieval as R


class Flaky:
    """Answers by the query's text; some queries fail."""

    def search(self, query, k):
        if query == "down":
            raise ConnectionError("no route")
        if query == "bad":
            return 503, "oops"
        if query == "text":
            return 200, "not json"
        return 200, json.dumps({"document_id": "d", "hits": [{"source_type": "s", "chunk_id": f"c{i}", "rank": i, "score": 1 / i, "text": "t"} for i in range(1, 4)]})


def questions(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, text string")


def codes(flags):
    return sorted((r.query_id, r.code) for r in flags.collect())


def test_one_backend_fails(spark):
    q = questions(spark, "fine", "down", "bad", "text", "  ")

    def broken(_):
        raise RuntimeError("index lost")

    answers = B.called(q, "sparse", Flaky).unionByName(B.planned(q, "vector", broken))
    hits, flags = B.fused(answers)
    assert [(r.query_id, r.rank, r.chunk_id, r.vector_rank) for r in hits.orderBy("rank").collect()] == [("0", 1, "c1", None), ("0", 2, "c2", None), ("0", 3, "c3", None)]
    assert codes(flags) == sorted([("0", "BACKEND_UNREACHABLE"), ("0", "HYBRID_SINGLE_BACKEND_EVIDENCE")] + [("1", "BACKEND_UNREACHABLE")] * 2 + [("2", "BACKEND_HTTP_ERROR"), ("2", "BACKEND_UNREACHABLE"), ("3", "BACKEND_HTTP_ERROR"), ("3", "BACKEND_UNREACHABLE")])
    assert {r.code for r in B.failed()(flags).collect()} == {"BACKEND_FAILED", "HYBRID_SINGLE_BACKEND_EVIDENCE"}
    lost = flags.where("query_id = '0' and code = 'BACKEND_UNREACHABLE'").first()
    assert json.loads(lost.context)["backend"] == "vector" and "index lost" in json.loads(lost.context)["error"]


def test_a_plan_that_fails_while_it_runs(spark):
    q = questions(spark, "a")
    search = lambda d: d.select("query_id", F.lit("s").alias("source_type"), F.lit("c").alias("chunk_id"), F.lit(1).alias("rank"), F.raise_error(F.lit("late")).cast("double").alias("score"))
    r = B.planned(q, "sparse", search).first()
    assert r.status is None and "late" in r.error


def test_hits_are_validated(spark):
    body = {
        "document_id": " x ", "index_stats": {"document_id": "d"}, "quality_flags": [{"code": "OLD", "severity": "error", "context": {"a": 1}}, {"severity": "huge"}, "no"],
        "hits": [5, None, "c", {"chunk_id": "c1"}, {"source_type": "s", "chunk_id": "  "}, {"source_type": "other", "chunk_id": "c1"}, {"source_type": " s ", "chunk_id": 7, "rank": "2", "score": "0.5", "text": ""}, {"source_type": "s", "chunk_id": "c8", "rank": 0, "score": True}, {"source_type": "s", "chunk_id": "c9", "rank": True, "distance": 0.25}, {"source_type": "s", "chunk_id": "c9", "rank": "x"}],
    }
    other = {"hits": [{"source_type": "s", "chunk_id": "7", "rank": 1, "score": 2, "text": "seven", "distance": 0.5}]}
    rows = [("q", "sparse", 200, json.dumps(body), None), ("q", "vector", 299, json.dumps(other), None), ("empty", "sparse", 200, "", None), ("empty", "vector", 200, '{"hits": []}', None)]
    hits, flags = B.fused(spark.createDataFrame(rows, B.ANSWER), sources=["s", "t"], expected_document="d")
    got = [(r.rank, r.chunk_id, round(r.rrf_score, 9), r.text, r.sparse_rank, r.sparse_score, r.vector_rank, r.vector_score, r.vector_distance) for r in hits.orderBy("rank").collect()]
    assert got == [(1, "7", round(1 / 62 + 1 / 61, 9), "seven", 2, 0.5, 1, 2.0, 0.5), (2, "c9", round(1 / 69 + 1 / 70, 9), "", 10, None, None, None, None), (3, "c8", round(1 / 68, 9), "", 8, None, None, None, None)]
    assert codes(flags) == sorted([("q", "BACKEND_HIT_INVALID")] * 3 + [("q", "BACKEND_HIT_KEY_INVALID")] * 3 + [("q", "SPARSE_OLD"), ("q", "SPARSE_BACKEND_FLAG"), ("q", "BACKEND_DOCUMENT_ID_MISMATCH"), ("q", "HYBRID_SINGLE_BACKEND_EVIDENCE"), ("empty", "BACKEND_HITS_INVALID"), ("empty", "SPARSE_NO_HITS"), ("empty", "VECTOR_NO_HITS"), ("empty", "HYBRID_NO_HITS")])
    severity = {r.code: r.severity for r in flags.collect()}
    assert severity["SPARSE_OLD"] == "error" and severity["SPARSE_BACKEND_FLAG"] == "warning" and severity["BACKEND_HIT_INVALID"] == "info"
    assert {json.loads(r.context)["observed"] for r in flags.where("code = 'BACKEND_DOCUMENT_ID_MISMATCH'").collect()} == {"x"}


def test_same_as_plain_fusion(spark):
    """Without failures the hits are those of the fusion of two lists."""
    q = questions(spark, "a", "b", "none")
    one = spark.createDataFrame([(i, "s", f"c{j}", j, 1.0 / j) for i in range(2) for j in range(1, 6)], "query_id int, source_type string, chunk_id string, rank int, score double")
    two = one.where("rank <= 3").withColumn("chunk_id", F.concat(F.lit("c"), (8 - F.col("rank")).cast("string")))
    hits, flags = B.fused(B.planned(q, "sparse", lambda _: one).unionByName(B.planned(q, "vector", lambda _: two)), weights={"vector": 0.5})
    pick = lambda d: sorted((str(r.query_id), r.rank, r.chunk_id, round(r.rrf_score, 9), r.sparse_rank, r.vector_rank) for r in d.collect())
    assert pick(hits) == pick(R.weighted_rrf(one, two, 10, (1.0, 0.5)))
    assert ("2", "HYBRID_NO_HITS") in codes(flags)
    none = q.limit(0)
    assert [x.count() for x in B.fused(B.planned(none, "sparse", lambda _: one.limit(0)))] == [0, 0]


def test_shared_folder_must_be_named_on_a_cluster():
    from ravelin.sources.store import store_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        store_dir(Session())
