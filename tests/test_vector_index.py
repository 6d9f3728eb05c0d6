"""Inverted lists against a scan of all vectors."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from ravelin.operators import retrieval as R
from ravelin.operators import vector_index as L


def both(spark, vectors, queries, k, **how):
    v = spark.createDataFrame([(f"c{i}", i, x) for i, x in enumerate(vectors)], "chunk_id string, pos int, embedding array<double>").repartition(3)
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, embedding array<double>")
    hits, reads = L.search(q, L.build(v, **how), k)
    pick = lambda d: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in d.collect())
    assert pick(hits) == pick(R.dense(q, v, k))
    return sorted(tuple(r) for r in reads.collect())


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 32)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 16))
    x = centers[rng.integers(0, 20, 1500)] + 0.05 * rng.normal(size=(1500, 16))
    x[100:140] = x[100]  # ties
    reads = both(spark, x.tolist(), x[::97].tolist(), 7, lists=20)
    assert sum(n for _, n in reads) < 0.25 * len(reads) * len(x)


def test_spread(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    both(spark, x.tolist(), rng.normal(size=(12, 8)).tolist(), 10)


def test_awkward_vectors(spark):
    x = [[1.0, 0.0], [2.0, 0.0], [0.0, 0.0], None, [None, 1.0], [], [0.0, 3.0], [-1.0, 0.0], [1.0, 1.0]]
    both(spark, x, [[1.0, 0.1], [0.0, 0.0], None, [-1.0, -1.0]], 20, lists=3)
    both(spark, [[0.0, 0.0], None], [[1.0, 0.1]], 5)
    both(spark, [], [[1.0, 0.1]], 5)


@pytest.mark.parametrize("k", [1, 5])
def test_queries_of_one_list(spark, monkeypatch, k):
    monkeypatch.setattr(L, "QUERY_BLOCK", 4)
    monkeypatch.setattr(L, "BLOCK", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) * [1, 0.01, 0.01, 0.01]
    both(spark, x.tolist(), (x[:30] * 1.01).tolist(), k, lists=2)


def test_training():
    rng = np.random.default_rng(4)
    centers = np.eye(6)
    x = centers[rng.integers(0, 6, 600)] + 0.02 * rng.normal(size=(600, 6))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    c = L.trained(x, 6, rounds=12)
    assert np.allclose((c * c).sum(axis=1), 1) and (x @ c.T).max(axis=1).mean() > 0.9


def test_search_gathers_no_queries_on_the_driver(spark):
    rows = spark.createDataFrame([(i, i, [float((i * 7 + j * 3) % 11 - 5) for j in range(8)]) for i in range(200)], "chunk_id long, pos long, embedding array<double>")
    asked = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    ix = L.build(rows)
    runs = spark._jsparkSession.sharedState().statusStore()
    before = runs.executionsList().size()
    assert L.search(asked, ix, 3)[0].count() == 30
    names = []
    for i in range(before, runs.executionsList().size()):
        nodes = runs.planGraph(runs.executionsList().apply(i).executionId()).allNodes()
        texts = [(nodes.apply(j).name(), nodes.apply(j).desc()) for j in range(nodes.size())]
        names += [n for n, d in texts if n.endswith("Join") and "list" in d]
    assert "SortMergeJoin" in names and "BroadcastHashJoin" not in names
