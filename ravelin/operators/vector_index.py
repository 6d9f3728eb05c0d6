"""Inverted lists for dense search: most vectors are never compared, yet the top k are those of a full scan.

Vectors of unit length go to the list of their nearest centroid and lie there in blocks by their
distance from it. A query first searches its nearest lists, which gives an upper bound r of the
distance of its k-th neighbour. By the triangle inequality a vector nearer than r lies between d - r
and d + r from a centroid at distance d from the query, so only blocks that reach into that range
are searched then; no other can hold one of the top k. What that saves depends on the vectors: in
clusters it is nearly all, among evenly spread ones of many dimensions little.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators.retrieval import ranked
from ravelin.sources.store import store_dir

#: Vectors that centroids are trained on (twice as many at most), lists at most, and rounds of training.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 2048, 8
#: Vectors of a block and queries that meet one together.
BLOCK, QUERY_BLOCK = 512, 512
#: Lists that a query searches first, at least.
PROBES = 3
#: Scores tie after nine digits, so bounds leave room for that.
SLACK = 2e-9


@dataclass
class Lists:
    """centroids (a row each), radius (of the farthest vector) and size of each list, blocks (list, low, high, c, p, vm)."""

    centroids: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    blocks: DataFrame


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are vectors other than zero and without nulls, these as unit vectors)."""
    found = [np.array(x, np.float64) if x and None not in x else None for x in column.to_pylist()]
    on = np.array([i for i, x in enumerate(found) if x is not None and np.isfinite(x).all() and x.any()], np.int64)
    if not len(on):
        return on, np.zeros((0, 0))
    m = np.array([found[i] for i in on.tolist()], np.float64)
    return on, m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def trained(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors, by spherical k-means; a centroid without vectors moves to the vector that is farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.sqrt((total * total).sum(axis=1)) < 1e-12)
        total[empty] = x[np.argsort(best)[: len(empty)]]
        c = total / np.sqrt((total * total).sum(axis=1, keepdims=True))
    return c


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, path: str | None = None) -> Lists:
    """The inverted lists of vectors(chunk_id, pos, embedding), written to a folder that driver and executors share.

    Centroids are trained on a bounded sample by the hash of the id; every vector is in the index.
    Zero vectors, and those with nulls, take no part.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    few = vectors.where(F.pmod(F.xxhash64("chunk_id"), F.lit(-(-n // sample) or 1)) == 0).select("embedding").limit(2 * sample)
    _, x = _unit(few.toArrow().column(0).combine_chunks())  # a bounded number of rows
    if not len(x):
        _, x = _unit(vectors.select("embedding").limit(sample).toArrow().column(0).combine_chunks())
    c = trained(x, lists or min(MOST_LISTS, max(1, round(n**0.5)))) if len(x) else np.zeros((0, 0))
    kind = vectors.schema["chunk_id"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            on, m = _unit(batch.column(2))
            if len(on):
                near = m @ c.T
                own = near.argmax(axis=1)
                take = pa.array(on)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(_distance(near[np.arange(len(on)), own])), batch.column(0).take(take), batch.column(1).take(take), pa.array([v.tobytes() for v in m], pa.binary())], ["list", "d", "chunk_id", "pos", "v"])

    def pack(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            list_ = t.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(list_)) + 1).tolist(), len(list_)]
            for a, b in zip(cuts, cuts[1:]):
                while b - a >= BLOCK or b < len(list_) and a < b:
                    yield block(t.slice(a, min(BLOCK, b - a)))
                    a = min(a + BLOCK, b)
                held = t.slice(a)
        if held is not None and held.num_rows:
            yield block(held)

    def block(t):
        d = t.column(1).to_numpy()
        one = lambda i, k: pa.array([t.column(i).to_pylist()], pa.list_(k))
        return pa.RecordBatch.from_arrays([pa.array([t.column(0)[0].as_py()], pa.int32()), pa.array([d.min()]), pa.array([d.max()]), one(2, t.schema.field(2).type), one(3, pa.int64()), pa.array([b"".join(t.column(4).to_pylist())], pa.binary())], ["list", "low", "high", "c", "p", "vm"])

    path = path or f"{store_dir(spark)}/ravelin-lists-{uuid.uuid4().hex}"
    rows = vectors.select("chunk_id", F.col("pos").cast("long").alias("pos"), "embedding").mapInArrow(assign, f"list int, d double, chunk_id {kind}, pos long, v binary")
    # by range, so that a list of any size is split by distance
    rows.repartitionByRange("list", "d").sortWithinPartitions("list", "d").mapInArrow(pack, f"list int, low double, high double, c array<{kind}>, p array<long>, vm binary").write.parquet(path)
    blocks = spark.read.parquet(path)
    radius, size = np.zeros(len(c)), np.zeros(len(c), np.int64)
    for r in blocks.groupBy("list").agg(F.max("high").alias("r"), F.sum(F.size("c")).alias("n")).collect():  # a row for each list
        radius[r.list], size[r.list] = r.r, r.n
    return Lists(c, radius, size, blocks)


def search(queries: DataFrame, ix: Lists, k: int = 5, probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """(hits, reads): the exact cosine top k for queries(query_id, embedding), as R.dense() gives them, and (query_id, compared), the vectors that each query was compared with."""
    c, radius, size = ix.centroids, ix.radius, ix.size
    q_kind, c_kind = queries.schema["query_id"].dataType.simpleString(), ix.blocks.schema["c"].dataType.elementType.simpleString()

    def first(batches):
        """Each query's nearest lists, as many as hold k vectors, and probes at least."""
        for batch in batches:
            on, m = _unit(batch.column(1))
            if not len(on) or not len(c):
                continue
            d = _distance(m @ c.T)
            order = np.argsort(d, axis=1, kind="stable")
            enough = (np.cumsum(size[order], axis=1) < k).sum(axis=1) + 1
            upto = np.minimum(np.maximum(enough, probes), len(c))
            row = np.repeat(np.arange(len(on)), upto)
            at = np.concatenate([order[i, :n] for i, n in enumerate(upto.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(on[row])), pa.array(at.astype(np.int32)), pa.array(d[row, at]), pa.array(np.full(len(row), 9.0)), pa.array([m[i].tobytes() for i in row.tolist()], pa.binary())], ["query_id", "list", "d", "r", "v"])

    def rest(batches):
        """The other lists that reach within r of a query: r follows from its k-th score so far."""
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            r = _distance(batch.column(2).to_numpy() - SLACK)
            d = _distance(m @ c.T)
            on = d - radius <= r[:, None]
            for i, done in enumerate(batch.column(3).to_pylist()):
                on[i, done] = False
            row, at = np.nonzero(on & (size > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(d[row, at]), pa.array(r[row]), pa.array([m[i].tobytes() for i in row.tolist()], pa.binary())], ["query_id", "list", "d", "r", "v"])

    def compare(batches):
        """The k best of each query in each block whose distances reach into its range."""
        for batch in batches:
            ids_kind, out_kind = (batch.schema.field(i).type.value_type for i in (0, 6))
            for qs, ds, rs, qm, low, high, cs, ps, vm in zip(*(batch.column(i).to_pylist() for i in range(9))):
                ds, rs = np.array(ds), np.array(rs)
                on = np.flatnonzero((ds - rs <= high) & (low <= ds + rs))
                score = np.frombuffer(qm, np.float64).reshape(len(qs), -1)[on] @ np.frombuffer(vm, np.float64).reshape(len(cs), -1).T
                place = np.array(ps, np.int64)
                best = np.lexsort((np.broadcast_to(place, score.shape), -np.round(score, 9)), axis=1)[:, :k]
                row, at = np.repeat(np.arange(len(on)), best.shape[1]), best.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([qs[on[i]] for i in row.tolist()], ids_kind), pa.array([cs[i] for i in at.tolist()], out_kind), pa.array(place[at]), pa.array(score[row, at]), pa.array(np.where(np.arange(len(row)) % max(best.shape[1], 1) == 0, len(cs), 0))], ["query_id", "chunk_id", "pos", "score", "compared"])

    def met(asked: DataFrame) -> DataFrame:
        """asked(query_id, list, d, r, v) against the blocks of their lists, many queries at a time."""
        salted = asked.withColumn("_n", F.floor((F.row_number().over(Window.partitionBy("list").orderBy("query_id")) - 1) / QUERY_BLOCK))
        # joined by sorting: Spark takes packs for as small as the queries and would gather all of them, with their vectors, on the driver
        packs = salted.groupBy("list", "_n").agg(F.collect_list(F.struct("query_id", "d", "r", "v")).alias("x"))  # QUERY_BLOCK at most
        packs = packs.select("list", F.col("x.query_id").alias("q"), F.col("x.d").alias("d"), F.col("x.r").alias("r"), F.aggregate("x.v", F.lit(b""), lambda a, b: F.concat(a, b)).alias("qm"))
        both = ix.blocks.join(packs.hint("merge"), "list").select("q", "d", "r", "qm", "low", "high", "c", "p", "vm")
        return both.mapInArrow(compare, f"query_id {q_kind}, chunk_id {c_kind}, pos long, score double, compared long")

    spark = queries.sparkSession
    kind = f"query_id {q_kind}, list int, d double, r double, v binary"
    folder = f"{store_dir(spark)}/ravelin-search-{uuid.uuid4().hex}"
    queries.select("query_id", "embedding").mapInArrow(first, kind).write.parquet(f"{folder}/first")
    asked = spark.read.parquet(f"{folder}/first")
    met(asked).write.parquet(f"{folder}/near")
    near = spark.read.parquet(f"{folder}/near")
    bound = ranked(near, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    # fewer than k so far: there are no more vectors
    more = asked.groupBy("query_id").agg(F.first("v").alias("v"), F.collect_list("list").alias("done")).join(bound.where(F.col("n") >= k), "query_id").select("query_id", "v", "least", "done").mapInArrow(rest, kind)
    met(more).write.parquet(f"{folder}/far")
    found = near.unionByName(spark.read.parquet(f"{folder}/far"))
    hits = ranked(found.drop("compared"), k).withColumn("distance", 1 - F.col("score"))
    return hits, found.groupBy("query_id").agg(F.sum("compared").alias("compared"))
