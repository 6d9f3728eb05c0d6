"""Registered queries of the retrieval pipeline's operators, each with SQL for an independent engine where it can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.functions import text as T
from ravelin.operators import backends as B
from ravelin.operators import chunking as C
from ravelin.operators import contents as I
from ravelin.operators import evaluation as V
from ravelin.operators import extraction as E
from ravelin.operators import extractor as X
from ravelin.operators import faq as Q
from ravelin.operators import generation as G
from ravelin.operators import requests as M
from ravelin.operators import retrieval as R
from ravelin.operators import service as S
from ravelin.operators import structure as D
from ravelin.operators import vector_index as L
from ravelin.sources.segments import FileIndex, Segments
from ravelin.sources.store import store_dir, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"), "text", F.col("source").alias("source_type"))


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def relevant(spark, sf_dir) -> DataFrame:
    """Chunks that hold a question's passage."""
    return V.holding(corpus(spark, sf_dir), questions(spark, sf_dir))


def bm25_index(spark, sf_dir, tokenize=T.tokens) -> R.Index:
    return R.stored_index(corpus(spark, sf_dir), tokenize)


# ---- tokens, statistics and sparse retrieval ------------------------------------------------------

WORDS = "list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> '')"
SPLIT = f"toks AS (SELECT doc_id, source, {WORDS.format(c='text')} AS w FROM documents)"
POST = f"{SPLIT}, dl AS (SELECT doc_id, source, len(w) AS dl FROM toks), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st), mr AS MATERIALIZED (SELECT avg(r) AS mean_r FROM raw), idf AS (SELECT term, df, CASE WHEN r >= 0 THEN r ELSE 0.25 * mean_r END AS idf FROM raw, mr)"
ASKED = f"q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({WORDS.format(c='text')}) AS term FROM benchmark) GROUP BY ALL)"
SCORED = f"{POST}, {ASKED}, s AS (SELECT q.item_id AS query_id, p.doc_id AS chunk_id, any_value(dl.source) AS source_type, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN p USING (term) JOIN dl ON dl.doc_id = p.doc_id, st GROUP BY ALL)"
TOP = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s WHERE round(score, 12) > 0"


@query(f"WITH {SPLIT} SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM toks")
def tokenize_ws(spark, sf_dir):
    w = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ").cast("binary")).alias("tokens_md5"))


STOP = ", ".join(f"'{w}'" for w in T.GERMAN_STOPWORDS)
GERMAN = "list_filter(regexp_extract_all(lower(regexp_replace(text, '§\\s*([0-9]+[a-zA-Z]?)', ' paragraf \\1 ', 'g')), '[A-Za-z0-9ÄÖÜäöüß]+'), lambda x: regexp_matches(x, '^[0-9]+$') OR (length(x) >= 2 AND NOT list_contains([" + STOP + "], x)))"


@query(f"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {GERMAN} AS w FROM documents)")
def tokenize_regex_stop(spark, sf_dir):
    w = T.tokens_german(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("tokens_md5"))


@query(f"WITH {POST} SELECT doc_id AS chunk_id, term, tf FROM p")
def bm25_term_stats(spark, sf_dir):
    return bm25_index(spark, sf_dir).postings.select("chunk_id", "term", "tf")


@query(f"WITH w AS (SELECT DISTINCT doc_id, unnest({WORDS.format(c='text')}) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM w GROUP BY term), r AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS r FROM df) SELECT term, df, round(CASE WHEN r >= 0 THEN r ELSE 0.25 * avg(r) OVER () END, 6) AS idf FROM r")
def bm25_idf(spark, sf_dir):
    return bm25_index(spark, sf_dir).df.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {POST} SELECT n, round(avgdl, 6) AS avgdl, (SELECT round(avg(r), 6) FROM raw) AS mean_idf FROM st")
def bm25_corpus_stats(spark, sf_dir):
    return bm25_index(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


def _sparse(spark, sf_dir, k):
    return R.bm25(questions(spark, sf_dir), bm25_index(spark, sf_dir), k)


def _texts(spark, sf_dir, k):
    """The hits with their texts. Hits are stored, so that their size is known and texts are not shuffled to meet a few."""
    return written(_sparse(spark, sf_dir, k), "hits").join(corpus(spark, sf_dir).select("chunk_id", "text"), "chunk_id")


@query(f"WITH {SCORED} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({TOP}) WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return _sparse(spark, sf_dir, 5).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {SCORED} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s WHERE round(score, 12) > 0 AND source_type IN ('src0', 'src1')) WHERE rank <= 5")
def bm25_topk_source_filter(spark, sf_dir):
    hits = R.bm25(questions(spark, sf_dir), bm25_index(spark, sf_dir), 5, F.col("source_type").isin("src0", "src1"))
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {SCORED} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({TOP}) WHERE rank <= 5")
def bm25_topk_refreshed(spark, sf_dir):
    """The search of an index that has followed its files: built on a folder where a part of the documents has other texts, then refreshed when these change."""
    folder = f"{store_dir(spark)}/ravelin-follow-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    put = lambda k, rows: rows.where(F.col("doc_id") % 4 == k).write.mode("overwrite").parquet(f"{folder}/files/part-{k}")
    for k in range(4):
        put(k, d if k else d.withColumn("text", F.concat(F.lit("other words "), F.reverse("text"))))
    pick = lambda rows: rows.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"), "text", F.col("source").alias("source_type"), *[c for c in rows.columns if c == "_path"])
    own = FileIndex(spark, f"{folder}/index", f"{folder}/files", pick)
    own.refresh()
    put(0, d)
    own.refresh()
    return R.bm25(questions(spark, sf_dir), own.index(), 5).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT source AS source_type, count(*) AS n_chunks FROM documents GROUP BY source")
def chunks_by_source(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("source_type").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(f"WITH d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark), t AS (SELECT id, unnest({WORDS.format(c='text')}) AS term FROM d) SELECT term, count(DISTINCT id) AS df FROM t GROUP BY term")
def bm25_combined_corpus(spark, sf_dir):
    """Documents and questions as one corpus. Terms are stored once they are counted, as mean and weights both ask for them."""
    more = questions(spark, sf_dir).select((-1 - F.col("query_id")).alias("chunk_id"), (-1 - F.col("query_id")).alias("pos"), "text")
    docs = R.counted(corpus(spark, sf_dir).drop("source_type").unionByName(more))
    return R.index(docs, docs=docs, seen=written(R.seen_terms(docs), "seen")).df.select("term", "df")


# ---- dense and hybrid -----------------------------------------------------------------------------

DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({c}, lambda x: x::DOUBLE * x::DOUBLE)))"
NEAR = f"n AS (SELECT vec_id, label, embedding, {NORM.format(c='embedding')} AS nn FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label, {DOT} / (a.nn * b.nn) AS score FROM n a JOIN n b ON a.vec_id % 100 = 0)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("pos"), "embedding", "label")


def _vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {NEAR} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    hits = R.dense(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir), 5)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {NEAR} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s WHERE label = 3) WHERE rank <= 5")
def vector_topk_filter(spark, sf_dir):
    hits = R.dense(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir), 5, F.col("label") == 3)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {NEAR} SELECT query_id, chunk_id, rank, round(1 / (1 + (1 - score)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 5")
def vector_score_proto(spark, sf_dir):
    hits = R.dense(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir), 5)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round(1 / (1 + F.col("distance")), 6).alias("score"))


@query(f"WITH {NEAR} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 10")
def vector_topk_lists(spark, sf_dir):
    hits, _ = L.search(_vector_queries(spark, sf_dir), L.build(_vectors(spark, sf_dir)), 10)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN label + 100 ELSE label END AS label, round(embedding[1]::DOUBLE * CASE WHEN vec_id % 10 = 0 THEN -1 ELSE 1 END, 6) AS head FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id + 1000000000, label, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id % 50 = 0")
def vector_upsert(spark, sf_dir):
    """The vectors stored, every tenth replaced, every seventh deleted, and some added under new ids."""
    v = table(spark, sf_dir, "embeddings")
    t = Segments(spark, f"{store_dir(spark)}/ravelin-upsert-{uuid.uuid4().hex}", "vec_id")
    t.upsert(v)
    t.upsert(v.where("vec_id % 10 = 0").withColumns({"embedding": F.transform("embedding", lambda x: -x), "label": F.col("label") + 100}))
    t.delete(v.where("vec_id % 7 = 0"))
    t.upsert(v.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000_000))
    return t.read().select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("head"))


BUCKETS = f"list_transform({WORDS.format(c='text')}, lambda w: (('0x' || substr(md5(w), 1, 4))::INT % 64)::INT)"
EMBED = "list_transform(range(0, 64), lambda i: len(list_filter(bk, lambda b: b = i))::DOUBLE)"
VECTORS = f"dv AS MATERIALIZED (SELECT doc_id, source, v, sqrt(list_dot_product(v, v)) AS nv FROM (SELECT doc_id, source, {EMBED} AS v FROM (SELECT doc_id, source, {BUCKETS} AS bk FROM documents))), qv AS MATERIALIZED (SELECT item_id, v, sqrt(list_dot_product(v, v)) AS nv FROM (SELECT item_id, {EMBED} AS v FROM (SELECT item_id, {BUCKETS} AS bk FROM asked))), vs AS (SELECT item_id AS query_id, doc_id AS chunk_id, list_dot_product(dv.v, qv.v) / (dv.nv * qv.nv) AS score FROM qv JOIN dv ON dv.nv > 0 AND qv.nv > 0)"


def strange_questions(spark, sf_dir) -> DataFrame:
    """The questions, and for each one of an unknown word and one without any."""
    q = questions(spark, sf_dir)
    unknown = q.select((-1 - 2 * F.col("query_id")).alias("query_id"), F.concat(F.lit("zzqx"), F.col("query_id").cast("string")).alias("text"))
    empty = q.select((-2 - 2 * F.col("query_id")).alias("query_id"), F.lit(" ").alias("text"))
    return q.unionByName(unknown).unionByName(empty)


STRANGE = "asked AS MATERIALIZED (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - 2 * item_id, 'zzqx' || item_id::VARCHAR FROM benchmark UNION ALL SELECT -2 - 2 * item_id, ' ' FROM benchmark)"
PLAIN = "asked AS MATERIALIZED (SELECT item_id, text FROM benchmark)"


def _two_lists(spark, sf_dir, k, asked=None):
    """Hits by words and hits by vectors, of the stored indexes."""
    asked = questions(spark, sf_dir) if asked is None else asked
    return R.bm25(asked, bm25_index(spark, sf_dir), k), R.dense(R.embedded(asked).drop("text"), R.stored_vectors(corpus(spark, sf_dir)), k).join(corpus(spark, sf_dir).select("chunk_id", "source_type"), "chunk_id")


def two(asked: str) -> str:
    return f"{asked}, {SCORED.replace('FROM benchmark', 'FROM asked')}, {VECTORS}, l1 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, score FROM s WHERE round(score, 12) > 0), l2 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, score FROM vs)"


TWO = two(PLAIN)


@query(f"WITH {TWO}, u AS (SELECT *, 0 AS list FROM l1 WHERE rank <= 5 UNION ALL SELECT *, 1 AS list FROM l2 WHERE rank <= 5), f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 1000 + rank) AS seen FROM u GROUP BY ALL) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank FROM f) WHERE rank <= 5")
def hybrid_rrf(spark, sf_dir):
    fused = R.rrf(list(_two_lists(spark, sf_dir, 5)), 5)
    return fused.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


WEIGHTED = "{two}, b AS (SELECT query_id, chunk_id, x.rank AS sparse_rank, y.rank AS vector_rank FROM (SELECT * FROM l1 WHERE rank <= 50) x FULL JOIN (SELECT * FROM l2 WHERE rank <= 50) y USING (query_id, chunk_id)), f AS (SELECT *, coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) + coalesce(0.5::DOUBLE / (60 + vector_rank), 0) AS rrf FROM b), w AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, least(sparse_rank, vector_rank), source, chunk_id) AS rank FROM f JOIN documents d ON d.doc_id = f.chunk_id)".replace("{two}", TWO)
STRANGE_WEIGHTED = WEIGHTED.replace(TWO, two(STRANGE))


def _weighted(spark, sf_dir, asked=None):
    a, b = _two_lists(spark, sf_dir, R.WINDOW, asked)
    return R.weighted_rrf(a, b, 10, (1.0, 0.5))


@query(f"WITH {WEIGHTED} SELECT query_id, chunk_id, rank, round(rrf, 6) AS rrf_score, coalesce(sparse_rank, 0) AS sparse_rank, coalesce(vector_rank, 0) AS vector_rank FROM w WHERE rank <= 10")
def hybrid_weighted_rrf(spark, sf_dir):
    n = lambda c: F.col(c).cast("long").alias(c)
    return _weighted(spark, sf_dir).select("query_id", "chunk_id", n("rank"), F.round("rrf_score", 6).alias("rrf_score"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sparse_rank", "vector_rank")])


@query(f"WITH {STRANGE_WEIGHTED}, k AS (SELECT query_id, count(sparse_rank) AS s, count(vector_rank) AS v, count(*) FILTER (sparse_rank IS NOT NULL AND vector_rank IS NOT NULL) AS both_ FROM w WHERE rank <= 10 GROUP BY ALL), a AS (SELECT item_id AS query_id, coalesce(s, 0) AS s, coalesce(v, 0) AS v, coalesce(both_, 0) AS both_ FROM asked LEFT JOIN k ON k.query_id = item_id) SELECT query_id, 'SPARSE_NO_HITS' AS code, 'info' AS severity FROM a WHERE s = 0 UNION ALL SELECT query_id, 'VECTOR_NO_HITS', 'info' FROM a WHERE v = 0 UNION ALL SELECT query_id, 'HYBRID_NO_HITS', 'warning' FROM a WHERE s + v = 0 UNION ALL SELECT query_id, 'HYBRID_SINGLE_BACKEND_EVIDENCE', 'info' FROM a WHERE s + v > 0 AND both_ = 0")
def hybrid_flags(spark, sf_dir):
    return R.retrieval_flags(_weighted(spark, sf_dir, strange_questions(spark, sf_dir)), strange_questions(spark, sf_dir))


def _answers(spark, sf_dir):
    """Answers of both backends, some of which fail: no reply, a status of 500, no list, and hits that are none among the others."""
    q = questions(spark, sf_dir)
    sparse, vector = _two_lists(spark, sf_dir, R.WINDOW)
    n = F.col("query_id").cast("long")
    a = B.planned(q, "sparse", lambda _: sparse.select("query_id", "source_type", "chunk_id", "rank", "score"))
    a = a.withColumns({"status": F.when(n % 7 == 1, F.lit(None)).when(n % 7 == 2, 500).otherwise(F.col("status")), "body": F.when(n % 7 == 3, '{"hits": {"a": 1}}').when(n % 7 == 4, F.regexp_replace("body", r"^\{\"hits\":\[", '{"document_id": "other", "quality_flags": [{"code": "SLOW", "severity": "odd"}, 5], "hits":[7,{"chunk_id":"x"},{"source_type":"s","chunk_id":" "},')).otherwise(F.col("body"))})
    b = B.planned(q, "vector", lambda _: vector.select("query_id", "source_type", "chunk_id", "score", "rank"))
    b = b.withColumns({"status": F.when(n % 7 == 5, F.lit(None)).when(n % 14 == 1, F.lit(None)).otherwise(F.col("status")), "body": F.when(n % 7 == 6, "[]").otherwise(F.col("body"))})
    return a.unionByName(b)


DEGRADED = f"{TWO}, x AS (SELECT query_id, chunk_id, rank AS sparse_rank FROM l1 WHERE rank <= 50 AND query_id % 7 NOT IN (1, 2, 3)), y AS (SELECT query_id, chunk_id, rank AS vector_rank FROM l2 WHERE rank <= 50 AND query_id % 7 NOT IN (5, 6) AND query_id % 14 <> 1), b AS (SELECT query_id, chunk_id, sparse_rank, vector_rank FROM x FULL JOIN y USING (query_id, chunk_id)), f AS (SELECT *, coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) + coalesce(0.5::DOUBLE / (60 + vector_rank), 0) AS rrf FROM b), w AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, least(sparse_rank, vector_rank), source, chunk_id::VARCHAR) AS rank FROM f JOIN documents d ON d.doc_id = f.chunk_id)"


@query(f"WITH {DEGRADED} SELECT query_id::VARCHAR AS query_id, chunk_id::VARCHAR AS chunk_id, rank, round(rrf, 6) AS rrf_score, sparse_rank, vector_rank FROM w WHERE rank <= 10")
def degraded_search(spark, sf_dir):
    hits, _ = B.fused(_answers(spark, sf_dir), 10, {"sparse": 1.0, "vector": 0.5})
    n = lambda c: F.col(c).cast("long").alias(c)
    return hits.select("query_id", "chunk_id", n("rank"), F.round("rrf_score", 6).alias("rrf_score"), n("sparse_rank"), n("vector_rank"))


@query(f"""WITH {DEGRADED}, i AS (SELECT item_id AS n, item_id::VARCHAR AS query_id FROM benchmark), t AS (SELECT query_id::VARCHAR AS query_id, count(*) AS hits, count(*) FILTER ((sparse_rank IS NULL) <> (vector_rank IS NULL)) AS one FROM w WHERE rank <= 10 GROUP BY 1), xs AS (SELECT DISTINCT query_id::VARCHAR AS query_id FROM x), ys AS (SELECT DISTINCT query_id::VARCHAR AS query_id FROM y),
g AS (SELECT query_id, 'BACKEND_UNREACHABLE' AS code, 'warning' AS severity FROM i WHERE n % 7 = 1 UNION ALL SELECT query_id, 'BACKEND_UNREACHABLE', 'warning' FROM i WHERE n % 7 = 5 OR n % 14 = 1 UNION ALL SELECT query_id, 'BACKEND_HTTP_ERROR', 'warning' FROM i WHERE n % 7 IN (2, 6) UNION ALL SELECT query_id, 'BACKEND_HITS_INVALID', 'warning' FROM i WHERE n % 7 = 3
UNION ALL SELECT query_id, 'BACKEND_HIT_INVALID', 'info' FROM i WHERE n % 7 = 4 UNION ALL SELECT query_id, 'BACKEND_HIT_KEY_INVALID', 'info' FROM i, range(2) WHERE n % 7 = 4 UNION ALL SELECT query_id, 'SPARSE_SLOW', 'warning' FROM i WHERE n % 7 = 4 UNION ALL SELECT query_id, 'BACKEND_DOCUMENT_ID_MISMATCH', 'warning' FROM i WHERE n % 7 = 4
UNION ALL SELECT query_id, 'SPARSE_NO_HITS', 'info' FROM i WHERE n % 7 NOT IN (1, 2) AND query_id NOT IN (SELECT query_id FROM xs) UNION ALL SELECT query_id, 'VECTOR_NO_HITS', 'info' FROM i WHERE n % 7 NOT IN (5, 6) AND n % 14 <> 1 AND query_id NOT IN (SELECT query_id FROM ys)
UNION ALL SELECT query_id, 'HYBRID_NO_HITS', 'warning' FROM i WHERE n % 14 <> 1 AND query_id NOT IN (SELECT query_id FROM t) UNION ALL SELECT query_id, 'HYBRID_SINGLE_BACKEND_EVIDENCE', 'info' FROM t WHERE one > 0) SELECT query_id, code, severity, count(*) AS n FROM g GROUP BY ALL""")
def degraded_flags(spark, sf_dir):
    _, flags = B.fused(_answers(spark, sf_dir), 10, {"sparse": 1.0, "vector": 0.5}, expected_document="d")
    return flags.groupBy("query_id", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, coalesce(array_to_string(list_transform(embedding[1:3], lambda x: round(x::DOUBLE, 3)::DECIMAL(9,3)::VARCHAR), ' > '), '') AS vector_head, coalesce(label::VARCHAR, '') AS label FROM embeddings")
def metadata_flatten(spark, sf_dir):
    head = F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double"), 3).cast("decimal(9,3)").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", T.flat_metadata(head, "array<string>").alias("vector_head"), T.flat_metadata(F.col("label"), "int").alias("label"))


@query("SELECT sha256('b=0.75' || chr(10) || 'k1=1.5' || chr(10) || string_agg(line, chr(10) ORDER BY line)) AS signature FROM (SELECT DISTINCT source || '|' || lang || '|' || count(*)::VARCHAR AS line FROM documents GROUP BY source, lang)")
def index_signature(spark, sf_dir):
    files = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_type"), F.col("lang").alias("file")).agg(F.count(F.lit(1)).alias("modified"))
    return R.index_signature(files, {"k1": 1.5, "b": 0.75})


@query("WITH r AS (SELECT source AS source_type, doc_id AS pos, CASE WHEN doc_id % 7 = 0 THEN '' ELSE (doc_id // 2)::VARCHAR END AS chunk_id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS text FROM documents), c AS (SELECT *, CASE WHEN trim(chunk_id) = '' THEN 'CHUNK_ID_MISSING' WHEN trim(text) = '' THEN 'CHUNK_TEXT_EMPTY' END AS code FROM r), d AS (SELECT *, row_number() OVER (PARTITION BY source_type, chunk_id, code IS NULL ORDER BY pos) AS n FROM c) SELECT source_type, coalesce(code, CASE WHEN n > 1 THEN 'CHUNK_ID_DUPLICATE' END) AS code, count(*) AS n_rows FROM d WHERE code IS NOT NULL OR n > 1 GROUP BY ALL")
def chunk_validation_flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = d.select(F.lit("x").alias("_"), F.col("source").alias("source_type"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.floor(F.col("doc_id") / 2).cast("string")).alias("chunk_id"), F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("text")).alias("text")).drop("_")
    return R.valid_chunks(raw)[1].groupBy("source_type", "code").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- evaluation -----------------------------------------------------------------------------------

REL = "rel AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
JUDGED = f"WITH {SCORED}, {REL}, h AS (SELECT * FROM ({TOP}) WHERE rank <= 10), w AS (SELECT query_id, count(*) AS want FROM rel GROUP BY 1), j AS (SELECT h.query_id, count(*) FILTER (rel.chunk_id IS NOT NULL AND rank <= 5) AS hit, min(rank) FILTER (rel.chunk_id IS NOT NULL) AS first FROM h LEFT JOIN rel ON rel.query_id = h.query_id AND rel.chunk_id = h.chunk_id GROUP BY 1), m AS (SELECT w.query_id, coalesce(hit, 0) / 5.0::DOUBLE AS p, coalesce(hit, 0)::DOUBLE / want AS r, coalesce(1.0::DOUBLE / first, 0) AS rr FROM w LEFT JOIN j USING (query_id))"


def _judged(spark, sf_dir):
    return V.per_query(questions(spark, sf_dir), _sparse(spark, sf_dir, 10), relevant(spark, sf_dir), 5)


@query(f"{JUDGED} SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(rr, 6) AS rr FROM m")
def precision_recall_mrr(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "rr")])


@query(f"{JUDGED} SELECT count(*) AS num_queries, round(coalesce(avg(p), 0), 6) AS precision_at_k, round(coalesce(avg(r), 0), 6) AS recall_at_k, round(coalesce(avg(rr), 0), 6) AS mrr, 5 AS k FROM m")
def retrieval_macro_metrics(spark, sf_dir):
    return V.macro(_judged(spark, sf_dir), 5).select("num_queries", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "mrr")], "k")


NOISE = f"WITH {POST}, {ASKED}, {REL}, rq AS (SELECT DISTINCT query_id FROM rel), keep AS (SELECT rq.query_id, dl.doc_id, dl.dl FROM rq CROSS JOIN dl ANTI JOIN rel ON rel.query_id = rq.query_id AND rel.chunk_id = dl.doc_id), kst AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM keep GROUP BY 1), kdf AS MATERIALIZED (SELECT query_id, term, count(*) AS df FROM keep JOIN p USING (doc_id) GROUP BY ALL), kraw AS MATERIALIZED (SELECT query_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM kdf JOIN kst USING (query_id)), kmean AS (SELECT query_id, avg(r) AS mean_r FROM kraw GROUP BY 1), ks AS (SELECT q.item_id AS query_id, p.doc_id AS chunk_id, sum(qtf * CASE WHEN r >= 0 THEN r ELSE 0.25 * mean_r END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * keep.dl / avgdl))) AS score FROM q JOIN kraw ON kraw.query_id = q.item_id AND kraw.term = q.term JOIN p ON p.term = q.term JOIN keep ON keep.query_id = q.item_id AND keep.doc_id = p.doc_id JOIN kst ON kst.query_id = q.item_id JOIN kmean ON kmean.query_id = q.item_id GROUP BY ALL), n AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ks WHERE round(score, 12) > 0)"


def _noise(spark, sf_dir, found, n=10):
    return V.distractors(questions(spark, sf_dir), bm25_index(spark, sf_dir), found, n)


@query(f"{NOISE} SELECT query_id, chunk_id, rank FROM n WHERE rank <= 10")
def distractors_topn(spark, sf_dir):
    return _noise(spark, sf_dir, relevant(spark, sf_dir)).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(f"{NOISE}, lv AS (SELECT unnest([0, 2, 5]) AS level), g AS (SELECT query_id, level, chunk_id FROM rel, lv UNION ALL SELECT query_id, level, chunk_id FROM n, lv WHERE rank <= level) SELECT query_id, level, row_number() OVER (PARTITION BY query_id, level ORDER BY md5(concat_ws('|', query_id, level, chunk_id))) AS place, chunk_id FROM g")
def distractor_context_grid(spark, sf_dir):
    found = relevant(spark, sf_dir)
    grid = V.context_grid(found, written(_noise(spark, sf_dir, found), "noise"), [0, 2, 5])
    return grid.select("query_id", "level", F.col("place").cast("long").alias("place"), "chunk_id")


@query("SELECT coalesce(level::VARCHAR, 'all') AS level, round(avg(correct::INT), 6) AS accuracy, count(DISTINCT query_id) AS questions FROM (SELECT doc_id AS query_id, (doc_id % 11)::INT AS level, quality = 1 AS correct FROM labels) GROUP BY ROLLUP (level)")
def generation_metrics_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), (F.col("doc_id") % 11).cast("int").alias("level"), (F.col("quality") == 1).alias("correct"))
    return V.accuracy(rows).select(F.coalesce(F.col("level").cast("string"), F.lit("all")).alias("level"), F.round("accuracy", 6).alias("accuracy"), "questions")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN quality = 1 WHEN 1 THEN toxic = 1 WHEN 2 THEN true WHEN 4 THEN true ELSE false END AS correct, CASE WHEN doc_id % 5 < 2 THEN (doc_id % 100) / 100.0 ELSE 0.5 END::DOUBLE AS confidence,
CASE doc_id % 5 WHEN 0 THEN 'r' || doc_id::VARCHAR WHEN 1 THEN 'ok' WHEN 2 THEN 'I think "correct": true here' WHEN 3 THEN '[1] no verdict' ELSE '' END AS reasoning FROM labels""")
def judge_parse(spark, sf_dir):
    n, flag = F.col("doc_id"), lambda c: F.when(F.col(c) == 1, "true").otherwise("false")
    sure = (n % 100 / 100).cast("string")
    plain = F.concat(F.lit('{"correct": '), flag("quality"), F.lit(', "confidence": '), sure, F.lit(', "reasoning": "r'), n.cast("string"), F.lit('"}'))
    fenced = F.concat(F.lit('```json\n{"correct": '), flag("toxic"), F.lit(', "confidence": "'), sure, F.lit('", "reasoning": "ok"}\n```'))
    reply = F.when(n % 5 == 0, plain).when(n % 5 == 1, fenced).when(n % 5 == 2, 'I think "correct": true here').when(n % 5 == 3, "[1] no verdict").otherwise('{"correct": true}')
    return table(spark, sf_dir, "labels").select("doc_id", V.judgement(reply).alias("j")).select("doc_id", "j.*")


# ---- extraction -----------------------------------------------------------------------------------

#: Unicode's blanks (category Zs).
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _flat(c):
    """A text on one line, without any blanks of Unicode around it, as SQL's trim has it."""
    return F.btrim(F.regexp_replace(c, r"[\x09-\x0D\x20]+", " "), F.lit(BLANKS))


FLAT = "trim(regexp_replace({c}, '[\\x09-\\x0D\\x20]+', ' ', 'g'))"


def _regulations(spark, sf_dir):
    """Five pages for each document, its whole text on the third and fifth: parts, paragraphs of numbers that follow the id, appendices. Of a null text or language the line is left empty, not the page null."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 40
    no = lambda i: (k + i).cast("string")
    line = lambda head, c: F.coalesce(F.concat(F.lit(head), c), F.lit(""))
    text = line("Text ", _flat(F.col("text")))
    pages = [
        F.concat(F.lit("Regulations of "), "source"),
        F.concat(F.lit("2\nTable of Contents\n§ "), no(1), F.lit(" Scope")),
        F.concat(F.lit("3\nI.\n"), line("General ", F.col("lang")), F.lit("\n§ "), no(1), F.lit("\nScope\n"), text, F.lit("  \n\n\n\nmore\n§ "), no(2), F.lit("\nGoals")),
        F.concat(F.lit("4\ngoal text\nII.\nExams\n§ "), no(3), F.lit("\n\n5\nForm\nbody")),
        F.concat(F.lit("Appendix 1: Plan\n"), text, F.lit("\nAppendix 2:\nModules\n§ "), no(3), F.lit("\nagain")),
    ]
    return d.select(F.col("doc_id"), F.posexplode(F.array(*pages)).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")


MARKED = """SELECT doc_id, 1 AS seq, 'preamble' AS kind, 'Preamble' AS label, '' AS title, 1 AS page, 0 AS line FROM documents UNION ALL SELECT doc_id, 2, 'toc', 'Table of Contents', '', 2, 0 FROM documents
UNION ALL SELECT doc_id, 3, 'part', 'I.', 'General ' || lang, 3, 1 FROM documents UNION ALL SELECT doc_id, 4, 'paragraph', '§' || (doc_id % 40 + 1)::VARCHAR, 'Scope', 3, 3 FROM documents
UNION ALL SELECT doc_id, 5, 'paragraph', '§' || (doc_id % 40 + 2)::VARCHAR, 'Goals', 3, 10 FROM documents UNION ALL SELECT doc_id, 6, 'part', 'II.', 'Exams', 4, 2 FROM documents
UNION ALL SELECT doc_id, 7, 'paragraph', '§' || (doc_id % 40 + 3)::VARCHAR, 'Form', 4, 4 FROM documents UNION ALL SELECT doc_id, 8, 'appendix', 'Appendix 1', 'Plan', 5, 0 FROM documents UNION ALL SELECT doc_id, 9, 'appendix', 'Appendix 2', 'Modules', 5, 2 FROM documents"""


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN md5(regexp_replace('7' || chr(10) || text, '\\A[ \\t]*\\d{1,2}[ \\t]*(\\n|\\z)', '')) ELSE md5('7' || chr(10) || text) END AS text_md5 FROM documents")
def strip_page_number(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("t", F.concat(F.lit("7\n"), "text"))
    return d.select("doc_id", F.md5(T.without_page_number(F.col("t"), 1 + F.col("doc_id") % 2).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10)), '[ \\t\\r\\f\\x0B]+(\\n|\\z)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '\\A\\s+|\\s+\\z', '', 'g')) AS text_md5 FROM documents")
def normalize_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.tidy(F.replace("text", F.lit(". "), F.lit(".  \n\n\n"))).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(text, 'e', 'e-' || chr(10)), '([0-9A-Za-z_])-\\n([0-9A-Za-z_])', '\\1\\2', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS text_md5 FROM documents")
def dehyphenate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.dehyphenated(F.replace("text", F.lit("e"), F.lit("e-\n"))).cast("binary")).alias("text_md5"))


@query(MARKED)
def markers(spark, sf_dir):
    return E.markers(_regulations(spark, sf_dir)).select("doc_id", "seq", "kind", "label", "title", "page", "line")


@query("WITH n AS (SELECT doc_id, doc_id % 40 AS k, unnest(range(1, 10)) AS seq FROM documents) SELECT doc_id, seq::INT AS seq, CASE seq WHEN 1 THEN 'preamble' WHEN 2 THEN 'toc' WHEN 3 THEN 'part-I' WHEN 4 THEN 'par-' || (k + 1)::VARCHAR WHEN 5 THEN 'par-' || (k + 2)::VARCHAR WHEN 6 THEN 'part-II' WHEN 7 THEN 'par-' || (k + 3)::VARCHAR WHEN 8 THEN 'appendix-1' ELSE 'appendix-2' END AS section_id, CASE WHEN seq IN (4, 5) THEN 'part-I' WHEN seq = 7 THEN 'part-II' END AS parent_section_id FROM n")
def section_parents(spark, sf_dir):
    return E.parents(E.markers(_regulations(spark, sf_dir))).select("doc_id", "seq", "section_id", "parent_section_id")


BODIES = [
    ("'preamble'", 1, 1, "'Regulations of ' || source"),
    ("'toc'", 2, 3, "concat_ws(chr(10), '2', 'Table of Contents', '§ ' || k + 1 || ' Scope', '3')"),
    ("'part-I'", 3, 3, "concat_ws(chr(10), 'I.', 'General ' || lang)"),
    ("'par-' || k + 1", 3, 3, "concat_ws(chr(10), '§ ' || k + 1, 'Scope', t, '', 'more')"),
    ("'par-' || k + 2", 3, 4, "concat_ws(chr(10), '§ ' || k + 2, 'Goals', '4', 'goal text')"),
    ("'part-II'", 4, 4, "concat_ws(chr(10), 'II.', 'Exams')"),
    ("'par-' || k + 3", 4, 4, "concat_ws(chr(10), '§ ' || k + 3, '', '5', 'Form', 'body')"),
    ("'appendix-1'", 5, 5, "concat_ws(chr(10), 'Appendix 1: Plan', t)"),
    ("'appendix-2'", 5, 5, "concat_ws(chr(10), 'Appendix 2:', 'Modules', '§ ' || k + 3, 'again')"),
]


@query(f"WITH d AS (SELECT doc_id, source, lang, (doc_id % 40)::INT AS k, 'Text ' || {FLAT.format(c='text')} AS t FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, {i} AS section_id, {a} AS start_page, {b} AS end_page, md5({t}) AS text_md5 FROM d" for i, a, b, t in BODIES).replace("k + 1", "(k + 1)").replace("k + 2", "(k + 2)").replace("k + 3", "(k + 3)"))
def sections(spark, sf_dir):
    return E.sections(_regulations(spark, sf_dir)).select("doc_id", "section_id", "start_page", "end_page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _modules(spark, sf_dir):
    """A wide table for each hundred parts: two rows for every third part, headers, labels and empty rows between."""
    p = table(spark, sf_dir, "part")
    k, none = F.col("p_partkey"), F.lit("")
    wide = lambda *x: F.array(x[0], none, F.lit("out"), x[1], x[2], F.lit("out"), none, *x[3:])
    main = wide(F.concat(F.lit("CS "), k.cast("string")), F.col("p_size").cast("string"), F.col("p_name"), F.lit(None).cast("string"), F.lit("a\nb"), F.col("p_brand"), none)
    more = wide(F.lit("ov"), none, F.col("p_type"), none, F.lit("c"), none, F.when(k % 2 == 0, "z"))
    head = wide(F.lit("Name of module"), F.lit("LP"), *[F.lit("x")] * 5)
    label = F.array(F.lit("Compulsory Elective Modules"), *[none] * 10)
    forms = [F.when(k % 20 == 0, head), F.when(k % 30 == 0, label), F.when(k >= 0, main), F.when(k % 3 == 0, more), F.when(k % 7 == 0, wide(*[F.lit(" ")] * 7))]
    rows = F.array(*[F.struct(F.lit(i).alias("at"), x.alias("cells")) for i, x in enumerate(forms)])
    return p.select(F.floor(k / 100).cast("string").alias("doc_id"), k.alias("key"), F.inline(rows)).where("cells is not null").select("doc_id", (F.col("key") * 10 + F.col("at")).alias("pos"), "cells")


@query("SELECT (p_partkey // 100)::VARCHAR AS doc_id, p_partkey * 10 + 2 AS pos, concat_ws('|', 'CS ' || p_partkey::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN ' ov' ELSE '' END, p_size::VARCHAR, concat_ws(' ', nullif(trim(p_name), ''), CASE WHEN p_partkey % 3 = 0 THEN nullif(trim(p_type), '') END), '', 'a b' || CASE WHEN p_partkey % 3 = 0 THEN ' c' ELSE '' END, trim(p_brand), CASE WHEN p_partkey % 6 = 0 THEN 'z' ELSE '' END) AS cells FROM part")
def table_continuation_merge(spark, sf_dir):
    return E.continued(E.wide_rows(_modules(spark, sf_dir)), len(E.WIDE_COLUMNS)).select("doc_id", "pos", F.array_join("cells", "|").alias("cells"))


@query("SELECT p_partkey // 10 AS table_id, 'name|brand|size' AS headers, count(*) AS n_rows, md5(string_agg(concat_ws('|', trim(p_name), p_brand, p_size), chr(10) ORDER BY p_partkey)) AS rows_md5 FROM part GROUP BY ALL")
def generic_table_clean(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("t", F.floor(F.col("p_partkey") / 10))
    body = p.select(F.lit("d").alias("doc_id"), F.col("t").alias("table_id"), F.col("p_partkey").alias("pos"), F.array("p_name", F.lit(None).cast("string"), "p_brand", F.col("p_size").cast("string")).alias("cells"))
    head = p.select(F.lit("d").alias("doc_id"), F.col("t").alias("table_id"), F.lit(-2).cast("long").alias("pos"), F.array(F.lit("name"), F.lit(""), F.lit("brand"), F.lit("size")).alias("cells")).distinct()
    made = E.generic_table(body.unionByName(head).unionByName(head.withColumns({"pos": F.lit(-1).cast("long"), "cells": F.array(F.lit(" "), F.lit(None).cast("string"), F.lit(""), F.lit(""))})))
    return made.select("table_id", F.array_join("headers", "|").alias("headers"), F.size("rows").cast("long").alias("n_rows"), F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").cast("binary")).alias("rows_md5"))




ASSIGN = "t AS (SELECT e.event_id AS table_seq, (e.event_id % 40)::INT AS page FROM events e), s AS (SELECT n_nationkey AS seq, 's-' || n_nationkey::VARCHAR AS section_id, CASE WHEN n_nationkey % 5 = 0 THEN 'part' WHEN n_nationkey % 5 = 1 THEN 'appendix' ELSE 'paragraph' END AS kind, n_nationkey AS a, n_nationkey + n_nationkey % 7 AS b FROM nation)"


def _tables_and_sections(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.lit("d").alias("doc_id"), F.col("event_id").alias("table_seq"), (F.col("event_id") % 40).cast("int").alias("page"))
    n = F.col("n_nationkey")
    s = table(spark, sf_dir, "nation").select(F.lit("d").alias("doc_id"), n.alias("seq"), F.concat(F.lit("s-"), n.cast("string")).alias("section_id"), F.when(n % 5 == 0, "part").when(n % 5 == 1, "appendix").otherwise("paragraph").alias("kind"), n.alias("start_page"), (n + n % 7).alias("end_page"))
    return t, s


@query(f"WITH {ASSIGN}, p AS (SELECT table_seq, page, section_id, row_number() OVER (PARTITION BY table_seq ORDER BY seq DESC) AS k FROM t JOIN s ON page BETWEEN a AND b) SELECT table_seq, page, section_id, section_id || '-tbl-' || row_number() OVER (PARTITION BY section_id ORDER BY table_seq)::VARCHAR AS table_id FROM p WHERE k = 1")
def assign_tables(spark, sf_dir):
    return E.assign_tables(*_tables_and_sections(spark, sf_dir)).drop("doc_id")


@query(f"WITH {ASSIGN}, p AS (SELECT table_seq, page, section_id, row_number() OVER (PARTITION BY table_seq ORDER BY b - a, CASE kind WHEN 'paragraph' THEN 0 WHEN 'appendix' THEN 1 WHEN 'part' THEN 2 ELSE 3 END, section_id) AS k FROM t JOIN s ON page BETWEEN a AND b) SELECT table_seq, page, section_id, section_id || '-tbl-' || row_number() OVER (PARTITION BY section_id ORDER BY table_seq)::VARCHAR AS table_id FROM p WHERE k = 1")
def assign_tables_smallest(spark, sf_dir):
    return E.assign_tables(*_tables_and_sections(spark, sf_dir), smallest=True).drop("doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE::VARCHAR END AS version_date FROM orders")
def german_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    months = F.array(*[F.lit(m) for m in ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")])
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "'Fassung vom 'd.M.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.date_format(d, "d. "), F.get(months, F.month(d) - 1), F.date_format(d, " yyyy"))).otherwise(F.lit("31.2.2020"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.german_date(text).cast("string").alias("version_date"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 THEN -1 ELSE 1 + p_partkey % 3999 END AS value FROM part")
def roman_numerals(spark, sf_dir):
    n = 1 + F.col("p_partkey") % 3999
    digits = [("", "M", "MM", "MMM"), *[("", i, i * 2, i * 3, i + v, v, v + i, v + i * 2, v + i * 3, i + x) for i, v, x in ("CDM", "XLC", "IVX")]]
    numeral = F.concat(*[F.get(F.array(*map(F.lit, d)), (F.floor(n / 10 ** (3 - k)) % 10).cast("int")) for k, d in enumerate(digits)])
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(T.roman(F.when(F.col("p_partkey") % 97 == 0, "abc").otherwise(numeral)), F.lit(-1)).cast("long").alias("value"))


@query(f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN '{D.DOCUMENT_TYPE}' END AS document_type, CASE WHEN o_orderkey % 2 = 0 THEN '{D.DOCUMENT_TYPE} ' || o_orderkey::VARCHAR WHEN o_orderkey % 3 = 0 THEN 'Muster-Universität Stadt' WHEN o_orderkey % 5 = 1 THEN 'Fachbereich Mathematik und Informatik' WHEN o_orderkey % 4 > 0 THEN 'in der Fassung vom ' || strftime(o_orderdate::DATE, '%-d.%-m.%Y') END AS title,
CASE WHEN o_orderkey % 3 = 0 THEN 'Muster-Universität Stadt' END AS institution, CASE WHEN o_orderkey % 4 > 0 THEN greatest(o_orderdate::DATE, DATE '1995-03-02')::VARCHAR END AS version_date, CASE WHEN o_orderkey % 5 = 0 THEN 'FB12' WHEN o_orderkey % 5 = 1 THEN 'Fachbereich Mathematik und Informatik' END AS faculty FROM orders""")
def document_context(spark, sf_dir):
    k = F.col("o_orderkey")
    lines = [F.when(k % 2 == 0, F.concat(F.lit(f"{D.DOCUMENT_TYPE} "), k.cast("string"))), F.when(k % 3 == 0, "Muster-Universität Stadt"), F.when(k % 5 == 0, "am FB 12").when(k % 5 == 1, "Fachbereich Mathematik und Informatik"), F.when(k % 4 > 0, F.date_format("o_orderdate", "'in der Fassung vom 'd.M.yyyy")), F.when(k % 4 > 0, "Fassung vom 2. März 1995")]
    pages = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit(1).alias("page"), F.concat_ws("\n", *lines).alias("text"))
    return D.context(pages)[0].withColumn("version_date", F.col("version_date").cast("string")).drop("total_pages")


def _capital(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.expr(f"substr({c}, 2)")))


def _statutes(spark, sf_dir):
    """A statute for each region: a part, then a paragraph for each nation, repeated at once on the next page for every third one, and an annex."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    body = F.concat(F.lit("§ "), k.cast("string"), F.lit("\nZiel "), _capital("n_name"), F.lit("\nTEXT zu diesem."), F.when(k % 3 == 0, F.concat(F.lit("\n§ "), k.cast("string"), F.lit("\nnoch mehr"))).otherwise(""))
    one = n.select(F.col("n_regionkey").alias("doc_id"), (2 + k).cast("int").alias("page"), body.alias("text"))
    first = r.select(F.col("r_regionkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("Vorwort\nIV. Teil "), _capital("r_name")).alias("text"))
    last = r.select(F.col("r_regionkey").alias("doc_id"), F.lit(99).alias("page"), F.lit("Anlage 1: Muster\nXYZ").alias("text"))
    return first.unionByName(one).unionByName(last)


@query("""WITH x AS (SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS n, n_nationkey AS k, 'Ziel ' || upper(n_name[1]) || lower(n_name[2:]) AS title FROM nation),
y AS (SELECT r_regionkey AS doc_id, 'sec_0001' AS section_id, NULL::VARCHAR AS parent_section_id, 'part' AS kind, 'IV' AS label, 'Teil ' || upper(r_name[1]) || lower(r_name[2:]) AS title, 1 AS start_page, 1 AS end_page, 'IV. Teil ' || upper(r_name[1]) || lower(r_name[2:]) AS text FROM region
UNION ALL SELECT doc_id, 'sec_' || lpad(n::VARCHAR, 4, '0'), 'sec_0001', 'paragraph', '§ ' || k::VARCHAR, title, (2 + k)::INT, (2 + k)::INT, concat_ws(chr(10), '§ ' || k::VARCHAR, title, 'TEXT zu diesem.', CASE WHEN k % 3 = 0 THEN '§ ' || k::VARCHAR || chr(10) || 'noch mehr' END) FROM x
UNION ALL SELECT doc_id, 'sec_' || lpad((max(n) + 1)::VARCHAR, 4, '0'), NULL, 'annex', 'Anlage 1', 'Muster', 99, 99, 'Anlage 1: Muster' || chr(10) || 'XYZ' FROM x GROUP BY doc_id)
SELECT *, text AS normalized_text FROM y""")
def statute_sections(spark, sf_dir):
    return D.parse_sections(_statutes(spark, sf_dir))[0]


@query("SELECT 'DUPLICATE_PARAGRAPH_MARKER_SKIPPED' AS code, 'info' AS severity, count(*) AS n FROM nation WHERE n_nationkey % 3 = 0 HAVING count(*) > 0")
def statute_flags(spark, sf_dir):
    return D.parse_sections(_statutes(spark, sf_dir))[1].groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey AS doc_id, count(*) AS n_chunks, min(chunk) AS first_chunk, max(chunk) AS last_chunk FROM (SELECT n_regionkey, 'ch_' || lpad(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::VARCHAR, 6, '0') AS chunk FROM (SELECT n_regionkey, n_nationkey FROM nation UNION ALL SELECT r_regionkey, 99 FROM region)) GROUP BY 1")
def service_chunks(spark, sf_dir):
    made = D.parse_sections(_statutes(spark, sf_dir))[0].select("doc_id", "section_id", F.substring("section_id", 5, 4).cast("int").alias("seq"), "kind", F.concat_ws(" ", "label", "title").alias("heading"), F.col("normalized_text").alias("text"))
    none = spark.createDataFrame([], "doc_id long, table_id string, seq int, section_id string, rows array<array<string>>")
    chunks = S.chunked(made, none)[0]
    return chunks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))


def _with_contents(spark, sf_dir):
    """A document of five pages for each ten rows: contents on the second page unless the number is divisible by three, going on on the third if it is even; whole texts on the first and fourth page, and entries without a heading on the fifth."""
    k = F.floor(F.col("doc_id") / 10)
    d = table(spark, sf_dir, "documents").groupBy(k.alias("k")).agg(F.min(F.struct("doc_id", "text")).alias("low"), F.max(F.struct("doc_id", "text")).alias("high"))
    like = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.concat(F.lit("§ "), (F.col("k") + i).cast("string"), F.lit(" x"))), "\n")
    prose = lambda c: F.concat(F.lit("Seite "), _flat(F.col(c)))
    pages = [prose("low.text"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("Inhaltsverzeichnis\n"), like)).otherwise("leer"), F.when(F.col("k") % 2 == 0, like).otherwise(prose("high.text")), prose("high.text"), like]
    return d.select(F.col("k").cast("string").alias("doc_id"), F.posexplode(F.array(*pages)).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")


@query("WITH k AS (SELECT DISTINCT doc_id // 10 AS k FROM documents) SELECT k::VARCHAR AS doc_id, 2 AS page FROM k WHERE k % 3 <> 0 UNION ALL SELECT k::VARCHAR, 3 FROM k WHERE k % 3 <> 0 AND k % 2 = 0")
def toc_pages(spark, sf_dir):
    return E.toc_pages(_with_contents(spark, sf_dir)).select("doc_id", "page")


def _contents(spark, sf_dir):
    """A document for each ten rows: its contents hold an entry for each, of a form that follows the id; some have no contents, some contents without entries."""
    d = table(spark, sf_dir, "documents").withColumns({"k": F.floor(F.col("doc_id") / 10), "i": F.col("doc_id") % 10})
    no, source, page = F.col("doc_id").cast("string"), F.col("source"), (F.col("doc_id") % 90 + 1).cast("string")
    lines = lambda *x: F.concat_ws("\n", *x)
    sign = F.concat(F.lit("§ "), no)
    twice = F.concat(sign, F.lit(" Doppelt"))
    forms = [
        lines(F.lit("I."), F.concat(F.lit("Teil "), source), page),
        lines(F.concat(sign, F.lit(" Titel "), source), page),
        lines(sign, F.concat(F.lit("Titel "), source), page),
        lines(sign, page),
        lines(sign, F.concat(F.lit("klein "), source), page),
        lines(twice, page, twice, page),
        F.concat(sign, F.lit(" abs. 2")),
        lines(F.concat(F.lit("Anlage "), no, F.lit(": Muster-")), F.concat(F.lit("bogen "), "lang"), page),
        lines(sign, F.concat(F.lit("§ "), no, F.lit("a Danach")), page),
        lines(F.concat(F.lit("II. Ende "), source), page),
    ]
    entry = F.get(F.array(*forms), F.col("i").cast("int"))
    made = d.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]), "\n").alias("e"), F.min(F.struct("doc_id", "text")).alias("first"))  # ten rows
    contents = F.when(F.col("k") % 7 == 5, "nur ein Satz").otherwise(F.col("e"))
    pages = F.array(F.concat(F.lit("Seite "), _flat(F.col("first.text"))), F.when(F.col("k") % 7 == 3, "leer").otherwise(F.concat(F.lit("Inhaltsverzeichnis\n"), contents)))
    return made.select(F.col("k").alias("doc_id"), F.posexplode(pages).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")


CONTENTS = """e AS (SELECT doc_id // 10 AS k, doc_id % 10 AS i, doc_id, CASE doc_id % 10 WHEN 0 THEN 'part' WHEN 9 THEN 'part' WHEN 7 THEN 'annex' ELSE 'paragraph' END AS kind, '§ ' || doc_id AS s, source, lang, doc_id % 90 + 1 AS p FROM documents WHERE doc_id % 10 <> 6 AND (doc_id // 10) % 7 NOT IN (3, 5)),
f AS (SELECT k, i, kind, CASE i WHEN 0 THEN 'I' WHEN 9 THEN 'II' WHEN 7 THEN 'Anlage ' || doc_id ELSE s END AS label,
  CASE i WHEN 0 THEN 'Teil ' || source WHEN 1 THEN 'Titel ' || source WHEN 2 THEN 'Titel ' || source WHEN 4 THEN 'klein ' || source WHEN 5 THEN 'Doppelt' WHEN 7 THEN 'Musterbogen ' || lang WHEN 8 THEN s || 'a Danach' WHEN 9 THEN 'Ende ' || source END AS title,
  CASE WHEN i NOT IN (2, 7) THEN p END AS referenced_page,
  CASE i WHEN 0 THEN concat_ws(chr(10), 'I.', 'Teil ' || source, p) WHEN 1 THEN concat_ws(chr(10), s || ' Titel ' || source, p) WHEN 2 THEN s WHEN 3 THEN concat_ws(chr(10), s, p) WHEN 4 THEN concat_ws(chr(10), s, 'klein ' || source, p) WHEN 5 THEN concat_ws(chr(10), s || ' Doppelt', p) WHEN 7 THEN 'Anlage ' || doc_id || ': Muster-' WHEN 8 THEN concat_ws(chr(10), s, s || 'a Danach', p) ELSE concat_ws(chr(10), 'II. Ende ' || source, p) END AS original_text FROM e),
g AS (SELECT *, 'toc_' || lpad(row_number() OVER (PARTITION BY k ORDER BY i)::VARCHAR, 4, '0') AS toc_id FROM f)"""


@query(f"WITH {CONTENTS} SELECT k AS doc_id, toc_id, CASE WHEN kind = 'paragraph' THEN last_value(CASE WHEN kind <> 'paragraph' THEN toc_id END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i) END AS parent_toc_id, kind, label, title, referenced_page, original_text, original_text AS normalized_text FROM g")
def contents_entries(spark, sf_dir):
    pages = _contents(spark, sf_dir)
    return I.parse_contents(pages, E.toc_pages(pages))[0]


@query("WITH k AS (SELECT DISTINCT doc_id // 10 AS k FROM documents) SELECT 'pdf_extractor' AS stage, CASE WHEN k % 7 = 3 THEN 'TOC_NOT_FOUND' ELSE 'TOC_PARSE_EMPTY' END AS code, 'warning' AS severity, '{\"doc_id\":' || k::VARCHAR || '}' AS context FROM k WHERE k % 7 IN (3, 5)")
def contents_flags(spark, sf_dir):
    pages = _contents(spark, sf_dir)
    return I.parse_contents(pages, E.toc_pages(pages))[1]


@query(f"""WITH d AS (SELECT doc_id, source, lang, (doc_id % 40)::INT AS k, 'Text ' || {FLAT.format(c='text')} AS t FROM documents),
s AS (SELECT doc_id, 1 AS seq, 'preamble' AS section_id, 1 AS start_page, 1 AS end_page, 'Regulations of ' || source AS text FROM d UNION ALL SELECT doc_id, 2, 'toc', 2, 2, 'Table of Contents' || chr(10) || '§ ' || (k + 1) || ' Scope' FROM d UNION ALL SELECT doc_id, 3, 'part-I', 3, 3, 'I.' || chr(10) || 'General ' || lang FROM d
  UNION ALL SELECT doc_id, 4, 'par-' || (k + 1), 3, 3, concat_ws(chr(10), '§ ' || (k + 1), 'Scope', t, '', 'more') FROM d UNION ALL SELECT doc_id, 5, 'par-' || (k + 2), 3, 4, concat_ws(chr(10), '§ ' || (k + 2), 'Goals', 'goal text') FROM d UNION ALL SELECT doc_id, 6, 'part-II', 4, 4, 'II.' || chr(10) || 'Exams' FROM d
  UNION ALL SELECT doc_id, 7, 'par-' || (k + 3), 4, 4, concat_ws(chr(10), '§ ' || (k + 3), '', '5', 'Form', 'body') FROM d UNION ALL SELECT doc_id, 8, 'appendix-1', 5, 5, 'Appendix 1: Plan' || chr(10) || t FROM d UNION ALL SELECT doc_id, 9, 'appendix-2', 5, 5, concat_ws(chr(10), 'Appendix 2:', 'Modules', '§ ' || (k + 3), 'again') FROM d)
SELECT doc_id, 5 AS total_pages, section_id, start_page, end_page, md5(text) AS text_md5, CASE WHEN doc_id % 4 < 3 AND seq = [5, 7, 9][doc_id % 4 + 1] THEN section_id || '-tbl-1: source|lang; ' || source || '|' || lang ELSE '' END AS tables FROM s JOIN (SELECT doc_id, source, lang FROM d) USING (doc_id)""")
def extracted_documents(spark, sf_dir):
    """Every document's pages and a raw table of its source and language on page three, four, five or one that does not exist."""
    d = table(spark, sf_dir, "documents")
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.array(*x).alias("cells")) for i, x in enumerate([(F.lit("source"), F.lit(" "), F.lit("lang")), (F.lit(""), F.lit("\n"), F.lit(None).cast("string")), (F.col("source"), F.lit(""), F.col("lang"))])])
    raw = d.select("doc_id", F.lit(1).alias("table_seq"), F.when(F.col("doc_id") % 4 == 3, 9).otherwise(F.col("doc_id") % 4 + 3).cast("int").alias("page"), F.inline(cells))
    made = X.extract(_regulations(spark, sf_dir), raw).select("doc_id", "total_pages", F.inline("sections"))
    row = lambda r: F.array_join(r, "|")
    shown = F.array_join(F.transform("tables", lambda t: F.concat(t["table_id"], F.lit(": "), row(t["headers"]), F.lit("; "), F.array_join(F.transform(t["rows"], row), "; "))), "\n")
    return made.select("doc_id", "total_pages", "section_id", "start_page", "end_page", F.md5(F.col("text").cast("binary")).alias("text_md5"), shown.alias("tables"))


@query("""WITH t AS (SELECT doc_id // 10 AS k, doc_id AS table_seq, (doc_id % 3 + 1)::INT AS page FROM documents), n AS (SELECT *, 'tbl_' || lpad(row_number() OVER (PARTITION BY k ORDER BY page, table_seq)::VARCHAR, 4, '0') AS table_id FROM t)
SELECT k AS doc_id, table_id, page, CASE WHEN page = 1 OR (page = 2 AND k % 7 = 3) THEN 'sec_0001' END AS section_id, CASE WHEN page = 1 OR (page = 2 AND k % 7 = 3) THEN 0 ELSE 1 END AS n_flags FROM n""")
def service_tables(spark, sf_dir):
    """Tables of the documents with contents, on pages inside and outside of their sections."""
    t = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("doc_id"), F.col("doc_id").alias("table_seq"), (F.col("doc_id") % 3 + 1).cast("int").alias("page"), F.array(F.array(F.col("source"), F.lit(None).cast("string"))).alias("rows"))
    made = X.run(_contents(spark, sf_dir), t)
    lost = made.flags.where("code = 'UNASSIGNED_TABLE'").select(F.get_json_object("context", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("context", "$.table_id").alias("table_id")).groupBy("doc_id", "table_id").agg(F.count(F.lit(1)).cast("int").alias("n_flags"))
    return made.tables.select("doc_id", "table_id", "page", "section_id").join(lost, ["doc_id", "table_id"], "left").fillna(0, ["n_flags"])


# ---- chunking and FAQ -----------------------------------------------------------------------------

SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '\\A\\s+|\\s+\\z', '', 'g')), lambda x: x <> '')"


@query(f"SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(1))) AS sentences_md5 FROM (SELECT doc_id, {SENT} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "\u0001").cast("binary")).alias("sentences_md5"))


def count_words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda y: y <> ''))"


PARTS = "list_filter(string_split_regex({x}, '\\s+'), lambda y: y <> '')"
CHUNKED = f"""d AS MATERIALIZED (SELECT doc_id, source, concat_ws(' > ', source, lang) AS head, 512 - {count_words("concat_ws(' > ', source, lang)")} AS room, {SENT} AS s FROM documents),
e AS MATERIALIZED (SELECT doc_id, source, head, room, flatten(list_transform(s, lambda x: CASE WHEN {count_words('x')} <= room THEN [x] ELSE list_transform(range(0, {count_words('x')}, room), lambda i: array_to_string(({PARTS.format(x='x')})[i + 1:i + room], ' ')) END)) AS p FROM d),
f AS MATERIALIZED (SELECT *, len(p) AS m, list_transform(range(0, len(p) + 1), lambda i: coalesce(list_sum(list_transform(p[1:i], lambda x: {count_words('x')})), 0)) AS cum FROM e WHERE len(p) > 0),
w AS (SELECT doc_id, 0::BIGINT AS st, list_max(list_filter(range(1, m + 1), lambda y: y = 1 OR cum[y + 1] - cum[1] + y - 1 <= room)) AS en FROM f
  UNION ALL SELECT doc_id, st, list_max(list_filter(range(st + 1, m + 1), lambda y: y = st + 1 OR cum[y + 1] - cum[st + 1] + y - st - 1 <= room)) FROM
  (SELECT w.doc_id, f.m, f.cum, f.room, list_min(list_filter(range(w.st + 1, w.en + 1), lambda x: f.cum[w.en + 1] - f.cum[x + 1] <= 50)) AS st FROM w JOIN f USING (doc_id) WHERE w.en < f.m)),
cl AS MATERIALIZED (SELECT doc_id, list(array_to_string(f.p[w.st + 1:w.en], ' ') ORDER BY w.st) AS cl FROM w JOIN f USING (doc_id) GROUP BY doc_id),
g AS (SELECT doc_id, 0 AS i, '' AS held, []::VARCHAR[] AS ready FROM cl
  UNION ALL SELECT doc_id, i + 1, CASE WHEN small AND fwd THEN cur ELSE '' END, CASE WHEN small AND fwd THEN ready WHEN small AND back THEN list_append(ready[1:len(ready) - 1], ready[-1] || ' ' || cur) ELSE list_append(ready, cur) END FROM
  (SELECT *, {count_words('cur')} < 64 AS small, after IS NOT NULL AND {count_words("cur || ' ' || after")} <= room AS fwd, len(ready) > 0 AND {count_words("ready[-1] || ' ' || cur")} <= room AS back FROM
    (SELECT g.doc_id, g.i, g.ready, f.room, CASE WHEN g.held = '' THEN cl[g.i + 1] ELSE g.held || ' ' || cl[g.i + 1] END AS cur, cl[g.i + 2] AS after FROM g JOIN cl USING (doc_id) JOIN f USING (doc_id) WHERE g.i < len(cl)))),
h AS (SELECT g.doc_id, f.source, f.head, unnest(g.ready) AS body, unnest(range(1, len(g.ready) + 1)) AS k FROM g JOIN cl USING (doc_id) JOIN f USING (doc_id) WHERE g.i = len(cl)),
chunks AS (SELECT doc_id::VARCHAR AS doc_id, source AS section_id, source || '-txt-' || k::VARCHAR AS chunk_id, 'text' AS chunk_type, head || chr(10) || chr(10) || body AS text, {count_words("head || ' ' || body")}::INT AS token_count, (k - 1)::INT AS chunk_index FROM h)"""


@query(f"WITH RECURSIVE {CHUNKED} SELECT * FROM chunks")
def window_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("section_id"), F.concat_ws(" > ", "source", "lang").alias("heading"), "text")
    return C.chunk_sections(d)


@query(f"WITH RECURSIVE {CHUNKED} SELECT count(*) AS total_chunks, coalesce(min(token_count), 0)::BIGINT AS min_tokens, coalesce(floor(median(token_count)), 0)::BIGINT AS median_tokens, coalesce(max(token_count), 0)::BIGINT AS max_tokens, coalesce(sum(token_count), 0)::BIGINT AS total_tokens FROM chunks")
def chunk_token_stats(spark, sf_dir):
    return C.token_stats(window_chunks(spark, sf_dir))


@query("SELECT p_partkey, concat_ws(' | ', nullif(trim(p_name), ''), nullif(trim(p_brand), ''), p_size::VARCHAR) AS line FROM part")
def table_rows_serialized(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.serialized_row(F.array("p_name", F.lit("  "), "p_brand", F.lit(None).cast("string"), F.col("p_size").cast("string"))).alias("line"))


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT (p_partkey // 500)::VARCHAR AS t, concat_ws(' | ', nullif(trim(p_name), ''), nullif(trim(p_brand), ''), p_size::VARCHAR) AS line, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) AS i FROM part),
r AS (SELECT t, i, line, 1 AS pack, 121 - {count_words('line')} AS spare FROM l WHERE i = 1
  UNION ALL SELECT l.t, l.i, l.line, CASE WHEN {count_words('l.line')} + 1 <= r.spare THEN r.pack ELSE r.pack + 1 END, CASE WHEN {count_words('l.line')} + 1 <= r.spare THEN r.spare ELSE 122 END - {count_words('l.line')} - 1 FROM r JOIN l ON l.t = r.t AND l.i = r.i + 1),
c AS (SELECT t, pack, 'Parts' || chr(10) || chr(10) || 'name | brand | size' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text FROM r GROUP BY t, pack)
SELECT 'parts' AS doc_id, t AS section_id, t || '-tbl-part-' || t || '-' || pack::VARCHAR AS chunk_id, 'table' AS chunk_type, text, {count_words('text')}::INT AS token_count, (pack - 1)::INT AS chunk_index FROM c""")
def table_chunks(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("t", F.floor(F.col("p_partkey") / 500).cast("string"))
    rows = p.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.array("p_name", "p_brand", F.col("p_size").cast("string")).alias("c")))), lambda x: x["c"]).alias("rows"))
    one = F.struct(F.concat(F.lit("part-"), "t").alias("table_id"), F.array(F.lit("name"), F.lit("brand"), F.lit("size")).alias("headers"), "rows")
    return C.chunk_sections(rows.select(F.lit("parts").alias("doc_id"), F.col("t").alias("section_id"), F.lit("Parts").alias("heading"), F.lit("").alias("text"), F.array(one).alias("tables")), 128, 16, 8)


def _heading_sections(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    top = r.select(F.lit("d").alias("doc_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("section_id"), F.lit(None).cast("string").alias("parent_section_id"), F.concat(F.col("r_regionkey").cast("string"), F.lit(".")).alias("label"), F.col("r_name").alias("title"))
    low = n.select(F.lit("d").alias("doc_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("section_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_section_id"), F.concat(F.lit("§"), F.col("n_nationkey").cast("string")).alias("label"), F.col("n_name").alias("title"))
    return top.unionByName(low)


@query("SELECT 'n' || n_nationkey::VARCHAR AS section_id, r_regionkey::VARCHAR || '. ' || r_name || ' > §' || n_nationkey::VARCHAR || ' ' || n_name AS heading FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey::VARCHAR, r_regionkey::VARCHAR || '. ' || r_name FROM region")
def heading_path(spark, sf_dir):
    return C.headings(_heading_sections(spark, sf_dir)).select("section_id", "heading")


def _tree(spark, sf_dir):
    """A tree of world, regions, nations, brands and parts, a chain of all parts and loops of two, three and one sections."""
    text = lambda *x: F.concat(*[F.lit(y) if y in ("w", "r", "n", "b", "p", "c", "x", "/") else F.col(y).cast("string") for y in x])
    row = lambda i, up, label, title: [F.lit("d").alias("doc_id"), i.alias("section_id"), (up if up is not None else F.lit(None).cast("string")).alias("parent_section_id"), label.cast("string").alias("label"), title.alias("title")]
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    part = table(spark, sf_dir, "part").withColumns({"of": F.col("p_partkey") % 25, "before": F.col("p_partkey") - 1, "other": F.col("p_partkey").bitwiseXOR(F.lit(1))})
    brand = part.select("of", "p_brand").distinct()
    rows = [
        region.limit(1).select(*row(F.lit("w"), None, F.lit(" "), F.lit("World"))),
        region.select(*row(text("r", "r_regionkey"), F.lit("w"), F.col("r_regionkey"), F.col("r_name"))),
        nation.select(*row(text("n", "n_nationkey"), text("r", "n_regionkey"), F.lit(None), F.col("n_name"))),
        brand.select(*row(text("b", "of", "/", "p_brand"), text("n", "of"), F.col("p_brand"), F.lit(""))),
        part.select(*row(text("p", "p_partkey"), text("b", "of", "/", "p_brand"), F.col("p_partkey"), F.lit(" T "))),
        part.select(*row(text("c", "p_partkey"), text("c", "before"), text("c", "p_partkey"), F.lit(None).cast("string"))),
        part.select(*row(text("x", "p_partkey"), F.when(F.col("p_partkey") % 5 == 0, text("x", "p_partkey")).otherwise(text("x", "other")), text("x", "p_partkey"), F.lit("loop"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


TREE = """t AS MATERIALIZED (SELECT 'w' AS id, NULL AS up, 'World' AS name UNION ALL SELECT 'r' || r_regionkey, 'w', r_regionkey || ' ' || r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT DISTINCT 'b' || p_partkey % 25 || '/' || p_brand, 'n' || p_partkey % 25, p_brand FROM part UNION ALL SELECT 'p' || p_partkey, 'b' || p_partkey % 25 || '/' || p_brand, p_partkey || ' T' FROM part
UNION ALL SELECT 'c' || p_partkey, 'c' || p_partkey - 1, 'c' || p_partkey FROM part UNION ALL SELECT 'x' || p_partkey, 'x' || CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE xor(p_partkey, 1) END, 'x' || p_partkey || ' loop' FROM part)""".replace("p_partkey % 25", "(p_partkey % 25)").replace("p_partkey - 1", "(p_partkey - 1)")


@query(f"WITH RECURSIVE {TREE}, a AS (SELECT id, up, name AS heading, 1 AS n FROM t UNION ALL SELECT a.id, t.up, t.name || ' > ' || a.heading, n + 1 FROM a JOIN t ON t.id = a.up WHERE n < 10) SELECT id AS section_id, arg_max(heading, n) AS heading, max(n) AS n_path FROM a GROUP BY id")
def heading_path_deep(spark, sf_dir):
    return C.headings(_tree(spark, sf_dir)).select("section_id", "heading", F.size("heading_path").alias("n_path"))


PAIRS = "pairs AS (SELECT conv_id, turn, text AS question, lead(text) OVER w AS answer, role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), e AS (SELECT 'f' || (conv_id % 3)::VARCHAR AS faq_source, conv_id * 1000 + turn AS pos, CASE WHEN conv_id % 13 = 0 THEN '' ELSE (conv_id // 2)::VARCHAR END AS id, trim(question) AS question, CASE WHEN conv_id % 17 = 0 THEN '' ELSE trim(answer) END AS answer FROM pairs WHERE role = 'user' AND next_role = 'assistant'), v AS (SELECT *, min(CASE WHEN id <> '' AND question <> '' AND answer <> '' THEN pos END) OVER (PARTITION BY faq_source, id) AS first FROM e), c AS (SELECT *, CASE WHEN id = '' THEN 'FAQ_ENTRY_INVALID' WHEN first < pos THEN 'FAQ_ID_DUPLICATE' WHEN question = '' THEN 'FAQ_EMPTY_QUESTION' WHEN answer = '' THEN 'FAQ_EMPTY_ANSWER' END AS code FROM v)"


def _entries(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf_dir, "conversations").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)}).where("role = 'user' and next_role = 'assistant'")
    return p.select(F.concat(F.lit("f"), (F.col("conv_id") % 3).cast("string")).alias("faq_source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.when(F.col("conv_id") % 13 == 0, "").otherwise(F.floor(F.col("conv_id") / 2).cast("string")).alias("id"), F.col("text").alias("question"), F.when(F.col("conv_id") % 17 == 0, "").otherwise(F.col("answer")).alias("answer"))


@query(f"WITH {PAIRS} SELECT faq_source, pos, faq_source || '-' || id AS chunk_id, 'Question: ' || question || chr(10) || 'Answer: ' || answer AS text FROM c WHERE code IS NULL")
def faq_chunks(spark, sf_dir):
    return Q.chunks(_entries(spark, sf_dir)).select("faq_source", "pos", "chunk_id", "text")


@query(f"WITH {PAIRS} SELECT faq_source, pos, code, 'warning' AS severity FROM c WHERE code IS NOT NULL UNION ALL SELECT faq_source, pos, 'FAQ_OVERSIZED_ENTRY', 'info' FROM c WHERE code IS NULL AND len(string_split_regex('Question: ' || question || chr(10) || 'Answer: ' || answer, '\\s+')) > 512")
def faq_quality_flags(spark, sf_dir):
    return Q.flags(_entries(spark, sf_dir))


@query(f"WITH {PAIRS}, k AS (SELECT faq_source, pos, 'faq_' || faq_source || '_' || CASE WHEN length(id) < 4 THEN lpad(id, 4, '0') ELSE id END AS chunk_id FROM c WHERE code IS NULL) SELECT faq_source, pos, chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM k WINDOW w AS (PARTITION BY faq_source ORDER BY pos)")
def faq_prev_next(spark, sf_dir):
    return Q.neighbours(_entries(spark, sf_dir)).drop("id")


def _service_entries(spark, sf_dir):
    """An entry for each question with an answer; ids of several spellings, some missing, some no objects; references to the number before and a spelling after."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c, n = F.col("conv_id"), F.floor(F.col("conv_id") / 4)
    text = n.cast("string")
    p = table(spark, sf_dir, "conversations").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)}).where("role = 'user' and next_role = 'assistant'")
    name = F.when(c % 11 == 0, " ").when(c % 4 == 1, F.concat(F.lit("Q "), text)).when(c % 4 == 2, F.concat(F.lit("q-"), text)).otherwise(F.concat(F.lit(" 00"), text))
    return p.select(
        F.when(c % 23 == 0, "empty").otherwise(F.concat(F.lit("f"), (c % 3).cast("string"))).alias("faq_source"), (c * 1000 + F.col("turn")).alias("pos"), (c % 19 != 0).alias("is_object"), name.alias("id"), F.col("text").alias("question"),
        F.when((c % 23 == 0) | (c % 17 == 0), " ").otherwise(F.col("answer")).alias("answer"), (n - 1).cast("string").alias("previous_question"), F.when(c % 2 == 0, F.concat(F.lit("Q "), text)).alias("next_question"),
        F.when(c % 5 == 0, "x").when(c % 5 == 1, "0").when(c % 5 == 2, c.cast("string")).alias("page"), F.concat(F.lit("siehe §  "), text, F.lit("a - 9 Abs. 1")).alias("section"),
    )


SERVICE_FAQ = """pairs AS (SELECT conv_id AS c, turn, text AS question, lead(text) OVER w AS answer, role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, c // 4 AS n, CASE WHEN c % 23 = 0 THEN 'empty' ELSE 'f' || (c % 3)::VARCHAR END AS faq_source, c * 1000 + turn AS pos, c % 19 <> 0 AS obj, CASE WHEN c % 11 = 0 THEN NULL WHEN c % 4 = 1 THEN 'Q ' || (c // 4)::VARCHAR WHEN c % 4 = 2 THEN 'q-' || (c // 4)::VARCHAR ELSE (c // 4)::VARCHAR END AS id, c % 23 <> 0 AND c % 17 <> 0 AND trim(question) <> '' AND trim(answer) <> '' AS whole FROM pairs WHERE role = 'user' AND next_role = 'assistant'),
i AS (SELECT *, CASE WHEN obj THEN 'faq_' || faq_source || '_' || CASE WHEN c % 4 IN (1, 2) THEN 'q_' || n::VARCHAR ELSE lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') END END AS chunk_id FROM e),
j AS (SELECT *, min(CASE WHEN obj AND whole AND id IS NOT NULL THEN pos END) OVER x AS first_pos, arg_min(id, pos) FILTER (obj AND whole AND id IS NOT NULL) OVER x AS first_id FROM i WINDOW x AS (PARTITION BY faq_source, CASE WHEN id IS NOT NULL THEN chunk_id END)),
v AS (SELECT *, CASE WHEN NOT obj THEN 'QUESTION_ITEM_NOT_OBJECT' WHEN id IS NULL THEN 'FAQ_ID_MISSING' WHEN pos > first_pos AND id = first_id THEN 'FAQ_ID_DUPLICATE' WHEN NOT whole THEN 'FAQ_EMPTY_QUESTION_OR_ANSWER' WHEN pos > first_pos THEN 'CHUNK_ID_COLLISION' END AS code, CASE WHEN c % 5 = 2 AND c > 0 THEN c END AS page FROM j),
ok AS (SELECT *, row_number() OVER y - 1 AS chunk_index, lag(chunk_id) OVER y AS prev_chunk_id, lead(chunk_id) OVER y AS next_chunk_id, (n - 1)::VARCHAR AS p_id, CASE WHEN c % 2 = 0 THEN 'Q ' || n::VARCHAR END AS n_id FROM v WHERE code IS NULL WINDOW y AS (PARTITION BY faq_source ORDER BY pos)),
r AS (SELECT ok.*, a.chunk_id AS p_chunk, b.chunk_id AS n_chunk FROM ok LEFT JOIN ok a ON a.faq_source = ok.faq_source AND a.id = ok.p_id LEFT JOIN ok b ON b.faq_source = ok.faq_source AND b.id = ok.n_id)"""


@query(f"WITH {SERVICE_FAQ} SELECT faq_source, pos, id AS faq_id, chunk_id, md5('Frage: ' || trim(question) || chr(10) || 'Antwort: ' || trim(answer)) AS text_md5, chunk_index::INT AS chunk_index, '§  ' || n::VARCHAR || 'a - 9' AS paragraph_label, page, prev_chunk_id, next_chunk_id, p_chunk AS previous_question_chunk_id, n_chunk AS next_question_chunk_id FROM r")
def faq_service_chunks(spark, sf_dir):
    made = Q.service_entries(_service_entries(spark, sf_dir))[0].withColumn("text_md5", F.md5(F.col("text").cast("binary")))
    return made.select("faq_source", "pos", "faq_id", "chunk_id", "text_md5", "chunk_index", "paragraph_label", "page", "prev_chunk_id", "next_chunk_id", "previous_question_chunk_id", "next_question_chunk_id")


@query(f"WITH {SERVICE_FAQ}, g AS (SELECT faq_source, code FROM v WHERE code IS NOT NULL UNION ALL SELECT faq_source, 'FAQ_PAGE_INVALID' FROM v WHERE (code IS NULL OR code = 'CHUNK_ID_COLLISION') AND c % 5 < 3 AND page IS NULL UNION ALL SELECT faq_source, 'PREVIOUS_QUESTION_REFERENCE_MISSING' FROM r WHERE p_chunk IS NULL UNION ALL SELECT faq_source, 'NEXT_QUESTION_REFERENCE_MISSING' FROM r WHERE n_id IS NOT NULL AND n_chunk IS NULL UNION ALL SELECT faq_source, 'ALL_QUESTIONS_SKIPPED' FROM v GROUP BY 1 HAVING count(*) FILTER (code IS NULL) = 0) SELECT faq_source, code, count(*) AS n FROM g GROUP BY ALL")
def faq_service_flags(spark, sf_dir):
    found = Q.service_entries(_service_entries(spark, sf_dir))[1]
    return found.groupBy(F.get_json_object("context", "$.faq_source").alias("faq_source"), "code").agg(F.count(F.lit(1)).alias("n"))


# ---- generation -----------------------------------------------------------------------------------


def _contexts(spark, sf_dir):
    hits = _texts(spark, sf_dir, 3)
    own = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("ctx"))
    return questions(spark, sf_dir).join(own, "query_id", "left").withColumn("ctx", F.coalesce("ctx", F.array().cast("array<string>")))


@query(f"WITH {SCORED}, h AS (SELECT t.query_id, string_agg('[' || t.rank::VARCHAR || '] ' || d.text, chr(10) || chr(10) ORDER BY t.rank) AS ctx FROM ({TOP}) t JOIN documents d ON d.doc_id = t.chunk_id WHERE t.rank <= 3 GROUP BY 1) SELECT item_id AS query_id, md5('Context:' || chr(10) || coalesce(ctx, '{G.NO_CONTEXT}') || chr(10) || chr(10) || 'Question: ' || text) AS user_md5 FROM benchmark LEFT JOIN h ON h.query_id = item_id")
def prompt_messages(spark, sf_dir):
    m = _contexts(spark, sf_dir).select("query_id", G.messages(F.col("text"), F.col("ctx")).alias("m"))
    return m.select("query_id", F.md5(F.get("m", F.lit(1))["content"].cast("binary")).alias("user_md5"))


@query(f"""WITH RECURSIVE {SCORED}, x AS MATERIALIZED (SELECT t.query_id, t.rank, {PARTS.format(x='d.text')} AS w, {count_words("'[CONTEXT] source_type=' || d.source || '; chunk_id=' || d.doc_id::VARCHAR || '; rank=' || t.rank::VARCHAR || ' text:'")} AS h, row_number() OVER (PARTITION BY t.query_id ORDER BY t.rank) AS i FROM ({TOP}) t JOIN documents d ON d.doc_id = t.chunk_id WHERE t.rank <= 10 AND trim(d.text) <> ''),
b AS (SELECT query_id, 0::BIGINT AS i, 0::BIGINT AS used, false AS done, NULL::INT AS rank, NULL::INT AS tokens, NULL::VARCHAR AS text, NULL::BOOLEAN AS truncated FROM x GROUP BY query_id
  UNION ALL SELECT query_id, i, CASE WHEN stop THEN used ELSE used + h + took END, stop, CASE WHEN NOT stop THEN rank::INT END, (h + took)::INT, array_to_string(w[1:greatest(took, 1)], ' '), NOT fits FROM
  (SELECT *, done OR (NOT fits AND (spare <= 32 OR spare - h - 1 < 16)) AS stop, CASE WHEN fits THEN len(w) ELSE least(spare - h - 1, len(w)) END AS took FROM
    (SELECT x.query_id, x.i, x.rank, x.w, x.h, b.used, b.done, {G.BUDGET - G.ANSWER - G.OVERHEAD} - b.used AS spare, x.h + len(x.w) <= {G.BUDGET - G.ANSWER - G.OVERHEAD} - b.used AS fits FROM b JOIN x ON x.query_id = b.query_id AND x.i = b.i + 1)))
SELECT query_id, rank, tokens, text, truncated FROM b WHERE rank IS NOT NULL""")
def context_budget(spark, sf_dir):
    hits = _texts(spark, sf_dir, 10)
    return G.budgeted(hits.select("query_id", "rank", G.preview(F.col("source_type"), F.col("chunk_id"), F.col("rank")).alias("head"), "text"))


@query(f"WITH {WEIGHTED}, k AS (SELECT query_id, count(*) AS n, max(rrf) AS best, count(*) FILTER (sparse_rank IS NOT NULL AND vector_rank IS NOT NULL) AS dual FROM w WHERE rank <= 10 GROUP BY 1), r AS (SELECT item_id AS query_id, CASE WHEN n IS NULL THEN 'NO_RETRIEVAL_HITS' WHEN n < 2 THEN 'NOT_ENOUGH_HITS' WHEN best < 0.015 THEN 'LOW_RELEVANCE_SCORE' WHEN dual < 1 THEN 'INSUFFICIENT_DUAL_BACKEND_EVIDENCE' END AS reason FROM benchmark LEFT JOIN k ON k.query_id = item_id) SELECT query_id, reason IS NOT NULL AS abstain, reason FROM r")
def abstention_decision(spark, sf_dir):
    return G.abstention(questions(spark, sf_dir), _weighted(spark, sf_dir))


@query("SELECT event_id, props AS found FROM events")
def llm_json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", G.json_object(F.concat(F.lit("Sure:\n"), "props", F.lit("\nDone."))).alias("found"))


@query(f"WITH {SCORED}, h AS (SELECT t.query_id, d.text FROM ({TOP}) t JOIN documents d ON d.doc_id = t.chunk_id WHERE t.rank = 1) SELECT item_id::VARCHAR AS query_id, coalesce(regexp_replace(left(split_part('[1] ' || h.text, chr(10), 1), 200), '\\A\\s+|\\s+\\z', '', 'g'), '{G.NO_CONTEXT}') AS answer, NULL::VARCHAR AS error FROM benchmark LEFT JOIN h ON h.query_id = item_id")
def generated_answers(spark, sf_dir):
    return G.generate(_contexts(spark, sf_dir).select("query_id", G.messages(F.col("text"), F.col("ctx")).alias("messages")))


@query(f"""WITH {SCORED}, h AS (SELECT t.query_id, string_agg('[' || t.rank::VARCHAR || '] ' || d.text, chr(10) || chr(10) ORDER BY t.rank) AS ctx, min(d.text) FILTER (t.rank = 1) AS top, string_agg(t.chunk_id::VARCHAR, ',' ORDER BY t.rank) AS ids FROM ({TOP}) t JOIN documents d ON d.doc_id = t.chunk_id WHERE t.rank <= 3 GROUP BY 1),
m AS (SELECT item_id::VARCHAR AS query_id, coalesce(ids, '') AS context_ids, coalesce(regexp_replace(left(split_part('[1] ' || top, chr(10), 1), 200), '\\A\\s+|\\s+\\z', '', 'g'), '{G.NO_CONTEXT}') AS answer, '{G.SYSTEM_PROMPT}' || ' Context:' || chr(10) || coalesce(ctx, '{G.NO_CONTEXT}') || chr(10) || chr(10) || 'Question: ' || text AS said FROM benchmark LEFT JOIN h ON h.query_id = item_id)
SELECT query_id, answer, NULL::VARCHAR AS error, len(regexp_extract_all(said, '[^\x20\x09-\x0D]+'))::BIGINT AS prompt_tokens, len(regexp_extract_all(answer, '[^\x20\x09-\x0D]+'))::BIGINT AS answer_tokens, context_ids FROM m""")
def model_requests(spark, sf_dir):
    """Answers with token counts and the ids of their contexts; equal prompts are asked once, replies stay in the shared folder."""
    hits = _texts(spark, sf_dir, 3)
    own = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("h"))
    asked = questions(spark, sf_dir).join(own, "query_id", "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<rank:int,chunk_id:bigint,text:string>>")))
    prompts = asked.select("query_id", G.messages(F.col("text"), F.transform("h", lambda x: x["text"])).alias("messages"), F.transform("h", lambda x: x["chunk_id"]).alias("context_ids"))
    return M.ask(prompts, M.Counting, f"{store_dir(spark)}/replies", "stand-in").withColumn("context_ids", F.array_join("context_ids", ","))
