"""Stored tables that change: versions, upserts and deletes, and an index that follows its files."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ravelin.operators import retrieval as R
from ravelin.sources.segments import FileIndex, Segments, Versions

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.read() is None and v.numbers() == []
    assert v.publish(lambda last: {"n": 1})["version"] == 1

    def late(last):
        """Another writer publishes while this one works; its change is seen."""
        if last["n"] == 1:
            Versions(spark, v.path).publish(lambda x: {"n": x["n"] + 10})
        return {"n": last["n"] + 1}

    assert v.publish(late) == {"n": 12, "version": 3} and v.read(2) == {"n": 11, "version": 2}
    (tmp_path / "t" / "versions" / "v000000004.json").write_text('{"n": 1')  # a writer that has not finished
    assert v.read()["version"] == 3 and v.publish(lambda x: {"n": x["n"]})["version"] == 5


def test_upserts(spark, tmp_path):
    t = Segments(spark, str(tmp_path / "t"), "id", buckets=4, most=3)
    with pytest.raises(FileNotFoundError):
        t.read()
    kind = "id long, name string, x array<float>"
    make = lambda r: spark.createDataFrame(r, kind)
    truth: dict = {}
    rng = random.Random(2)
    states = []
    for step in range(9):
        if step % 3 == 2:
            ids = rng.sample(range(60), 12) + [999]
            states.append(t.delete(make([(i, None, None) for i in ids])))
            truth = {k: v for k, v in truth.items() if k not in ids}
        else:
            new = {i: (i, f"s{step}" if i % 5 else None, [float(step)] if i % 7 else None) for i in rng.sample(range(60), 25)}
            states.append(t.upsert(make([*new.values(), (None, "no id", None)])))
            truth |= new
        assert sorted((r.id, r.name, r.x) for r in t.read().collect()) == sorted(truth.values())
    assert all(sum(b in s["buckets"] for s in states[-1]["segments"]) <= 3 for b in range(4))  # merged when there were more
    first = {r.id for r in t.read(states[0]["version"]).collect()}
    assert len(first) == 25  # an old version reads as it was
    assert t.versions.sweep() > 0 and sorted((r.id, r.name, r.x) for r in t.read().collect()) == sorted(truth.values())


def test_only_touched_buckets(spark, tmp_path):
    t = Segments(spark, str(tmp_path / "t"), "id", buckets=8, most=2)
    t.upsert(spark.range(200))
    one = spark.createDataFrame([(7,)], "id long")
    for _ in range(2):
        state = t.upsert(one)
    first = state["segments"][0]["buckets"]
    assert len(first) == 7 and all(len(s["buckets"]) == 1 for s in state["segments"][1:])  # one bucket was merged, the others lie where they lay
    assert rows(t.read()) == [(i,) for i in range(200)]


def test_repeats_in_a_batch(spark, tmp_path):
    t = Segments(spark, str(tmp_path / "t"), "id")
    t.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, s string"))
    assert [r.id for r in t.read().orderBy("id").collect()] == [1, 2]
    t.delete(spark.createDataFrame([(1,), (1,), (2,)], "id long"))
    assert t.read().collect() == [] and t.read().columns == ["id", "s"]


def scores(spark, ix):
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return sorted((r.query_id, r.chunk_id, round(r.score, 6)) for r in R.bm25_scores(asked, ix).collect())


def test_index_follows_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    put = lambda part, df: df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "files" / part))
    for k in range(4):
        put(f"p{k}", docs.where(F.col("doc_id") % 4 == k))
    pick = lambda d: d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"), "text", F.col("source").alias("source_type"), *[c for c in d.columns if c == "_path"])
    own = FileIndex(spark, str(tmp_path / "ix"), str(tmp_path / "files"), pick, most=3)
    with pytest.raises(FileNotFoundError):
        own.index()

    def check(read, gone):
        got = own.refresh()
        assert (got["read"], got["gone"]) == (read, gone)
        whole = R.index(pick(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "files"))))
        ix = own.index()
        assert rows(ix.df.select("term", "df")) == rows(whole.df.select("term", "df"))
        a, b = ix.stats.first(), whole.stats.first()
        assert a.n == b.n and abs(a.avgdl - b.avgdl) < 1e-9 and abs(a.mean_idf - b.mean_idf) < 1e-9
        assert scores(spark, ix) == scores(spark, whole)
        return got

    first = check(4, 0)
    check(0, 0)
    time.sleep(1.1)
    put("p1", docs.where(F.col("doc_id") % 4 == 1).withColumn("text", F.concat(F.lit("changed "), "text")))
    check(1, 1)
    put("p9", docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 10_000))
    check(1, 0)
    for f in (tmp_path / "files" / "p2").iterdir():
        f.unlink()
    assert len(check(0, 1)["generations"]) == 3
    put("p8", docs.where("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 20_000))
    assert len(check(1, 0)["generations"]) == 1  # merged, nothing read again
    assert len(scores(spark, own.index(first["version"]))) > 0
