"""Hybrid search over backends that may fail: a failing backend is a flag for its queries, and the other one's hits remain.

A backend answers a query with a status and a JSON text, {"hits": [...], "quality_flags": [...], ...}.
Services are called inside tasks, one query at a time, so one query's failure is its own; a plan of
this engine is run as a whole and fails as a whole. Answers are parsed as VARIANT: what is not of the
expected form becomes a flag, all else is used. Queries that no backend has answered have no hits, and the
failure of each backend among their flags.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators import flags as Z
from ravelin.operators.retrieval import RRF, WINDOW
from ravelin.sources.store import written

ANSWER = "query_id string, backend string, status int, body string, error string"


class Service(Protocol):
    """A client of a retrieval service; what it raises means that the service cannot be reached."""

    def search(self, query: str, k: int) -> tuple[int, str]:
        """(status, JSON text)."""


def called(queries: DataFrame, backend: str, service: Callable[[], Service], k: int = WINDOW) -> DataFrame:
    """(query_id, backend, status, body, error) of a service for queries(query_id, text). Each task has a client of its own; blank queries are not sent."""

    def run(batches):
        client = service()
        for batch in batches:
            rows = []
            for query_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                status, body, error = None, None, None
                try:
                    status, body = client.search(text, k)
                except Exception as e:  # whatever a client raises is this query's failure, not the job's
                    error = f"{type(e).__name__}: {e}"[:500]
                rows.append((query_id, backend, status, body, error))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["query_id", "backend", "status", "body", "error"])

    return queries.select(F.col("query_id").cast("string").alias("query_id"), F.trim("text").alias("text")).where("text <> ''").mapInArrow(run, ANSWER)


def planned(queries: DataFrame, backend: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same of a plan: search gives hits (query_id, source_type, chunk_id, rank, score, ...) of all queries. If it fails, so does each query."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.trim("text").alias("text")).where("text <> ''").select("query_id")
    none = lambda t: F.lit(None).cast(t)
    try:
        hits = search(queries)
        fields = [F.col(c) for c in hits.columns if c != "query_id"]
        lists = hits.select(F.col("query_id").cast("string").alias("query_id"), "rank", F.struct(*fields).alias("h")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "h"))), lambda x: x["h"]).alias("hits"))  # a query's hits
        lists = written(lists.select("query_id", F.to_json(F.struct("hits")).alias("body")), f"hits-{backend}")
    except Exception as e:  # analysis and execution alike
        return asked.select("query_id", F.lit(backend).alias("backend"), none("int").alias("status"), none("string").alias("body"), F.lit(f"{type(e).__name__}: {e}"[:500]).alias("error"))
    return asked.join(lists, "query_id", "left").select("query_id", F.lit(backend).alias("backend"), F.lit(200).alias("status"), F.coalesce("body", F.lit('{"hits": []}')).alias("body"), none("string").alias("error"))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column, path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def _whole(v: Column, path: str) -> Column:
    """A whole number, or a text of one; null otherwise."""
    return F.when(~_is(F.try_variant_get(v, path, "variant"), "BOOLEAN") & _text(v, path).rlike(r"^[+-]?\d+$"), F.try_variant_get(v, path, "bigint"))


def _real(v: Column, path: str) -> Column:
    return F.when(~_is(F.try_variant_get(v, path, "variant"), "BOOLEAN"), F.try_variant_get(v, path, "double"))


def fused(answers: DataFrame, k: int = 10, weights: dict[str, float] | None = None, sources: list[str] | None = None, expected_document: str | None = None, constant: int = RRF) -> tuple[DataFrame, DataFrame]:
    """(hits, flags) of the answers of the backends sparse and vector.

    hits: query_id, rank, rrf_score, source_type, chunk_id, text, sparse_rank, sparse_score, vector_rank, vector_score, vector_distance.
    A hit without a rank of one or more has that of its place. A hit that a backend gives twice counts twice, and its last rank is kept.
    flags: query_id, stage, code, severity, context.
    """
    weights = weights or {}
    body = F.when(F.col("status").between(200, 299), F.try_parse_json(F.when(F.trim("body") == "", "{}").otherwise(F.col("body"))))
    a = answers.withColumn("v", body)
    a = a.withColumn("ok", _is(F.col("v"), "OBJECT"))
    # both the flags and the hits come from here: parsed once, a row for each answer and place
    v = F.col("v")
    listed = F.try_variant_get(v, "$.hits", "variant")
    a = a.withColumn("is_list", _is(listed, "ARRAY")).withColumn("hits", F.when(F.col("is_list"), F.try_variant_get(v, "$.hits", "array<variant>")))
    parts = a.where("ok").select("query_id", "backend", F.posexplode("hits").alias("at", "h"))
    h = F.col("h")
    kind = F.when(~_is(h, "OBJECT"), "BACKEND_HIT_INVALID")
    source, chunk = _text(h, "$.source_type"), _text(h, "$.chunk_id")
    known = source.isNotNull() if sources is None else source.isin(sources)
    rank = _whole(h, "$.rank")
    parts = parts.select(
        "query_id", "backend", (F.col("at") + 1).alias("position"), F.coalesce(kind, F.when(~F.coalesce(known, F.lit(False)) | chunk.isNull(), "BACKEND_HIT_KEY_INVALID")).alias("code"), source.alias("source_type"), chunk.alias("chunk_id"),
        F.when(rank >= 1, rank).otherwise(F.col("at") + 1).alias("rank"), _real(h, "$.score").alias("score"), _real(h, "$.distance").alias("distance"), F.coalesce(F.try_variant_get(h, "$.text", "string"), F.lit("")).alias("text"),
    )
    parts = written(parts, "parts")
    weight = F.coalesce(*[F.when(F.col("backend") == b, F.lit(float(w))) for b, w in weights.items()], F.lit(1.0))
    last = lambda b, c: F.max_by(F.when(F.col("backend") == b, F.col(c)), F.when(F.col("backend") == b, F.col("position")))
    both = parts.where("code is null").groupBy("query_id", "source_type", "chunk_id").agg(
        F.sum(weight / (constant + F.col("rank"))).alias("rrf_score"), F.coalesce(F.min_by(F.when(F.col("text") != "", F.col("text")), F.when(F.col("text") != "", F.struct("backend", "position"))), F.lit("")).alias("text"),
        last("sparse", "rank").alias("sparse_rank"), last("sparse", "score").alias("sparse_score"), last("vector", "rank").alias("vector_rank"), last("vector", "score").alias("vector_score"), last("vector", "distance").alias("vector_distance"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), F.least("sparse_rank", "vector_rank"), "source_type", "chunk_id")
    hits = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    hits = written(hits.select("query_id", "rank", "rrf_score", "source_type", "chunk_id", "text", "sparse_rank", "sparse_score", "vector_rank", "vector_score", "vector_distance"), "fused")

    # one row of each query for what is counted, and one of each answer for what it says itself
    valid = parts.where("code is null").groupBy("query_id", "backend").agg(F.count(F.lit(1)).alias("valid"))
    per = a.join(valid, ["query_id", "backend"], "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    one = hits.groupBy("query_id").agg(F.count_if(F.col("sparse_rank").isNull() != F.col("vector_rank").isNull()).alias("count"))
    asked = answers.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked")).join(a.where("ok").groupBy("query_id").agg(F.count(F.lit(1)).alias("answered")), "query_id", "left").join(one, "query_id", "left")
    none = per.where("ok and valid = 0")
    own = per.where("ok").select("query_id", "backend", F.explode(F.try_variant_get(v, "$.quality_flags", "array<variant>")).alias("f")).where(_is(F.col("f"), "OBJECT"))
    f = F.col("f")
    severity_ = F.try_variant_get(f, "$.severity", "string")
    carried = own.select("query_id", F.lit("retrieval").alias("stage"), F.concat(F.upper("backend"), F.lit("_"), F.coalesce(_text(f, "$.code"), F.lit("BACKEND_FLAG"))).alias("code"), F.when(severity_.isin("info", "warning", "error"), severity_).otherwise("warning").alias("severity"), F.to_json(F.struct("backend", F.when(_is(F.try_variant_get(f, "$.context", "variant"), "OBJECT"), F.to_json(F.try_variant_get(f, "$.context", "variant"))).alias("context"))).alias("context"))
    seen = F.array_distinct(F.array_compact(F.array(_text(v, "$.document_id"), _text(v, "$.index_stats.document_id"))))
    other = per.where("ok").select("query_id", "backend", F.explode(seen).alias("observed")).where(F.col("observed") != F.lit(expected_document)) if expected_document is not None else None

    def flagged(rows: DataFrame, code, *context: str) -> DataFrame:
        key = rows.select("query_id", *[c for c in rows.columns if c != "query_id"])
        c = F.lit(code) if isinstance(code, str) else code
        made = key.select("query_id", F.lit("retrieval").alias("stage"), c.alias("code"), Z.severity(c).alias("severity"), F.to_json(F.struct(*context)).alias("context") if context else F.lit("{}").alias("context"))
        return made.where("code is not null")

    flags = [
        flagged(per.where("not ok"), F.when(F.col("status").isNull(), "BACKEND_UNREACHABLE").otherwise("BACKEND_HTTP_ERROR"), "backend", "status", "error"),
        flagged(per.where("ok and not is_list"), "BACKEND_HITS_INVALID", "backend"),
        flagged(parts, F.col("code"), "backend", "position"),
        flagged(none, F.when(F.col("backend") == "sparse", "SPARSE_NO_HITS").otherwise("VECTOR_NO_HITS")),
        flagged(asked.where("answered is not null and count is null"), "HYBRID_NO_HITS"),
        flagged(asked.where("count > 0"), "HYBRID_SINGLE_BACKEND_EVIDENCE", "count"),
        carried,
    ]
    if other is not None:
        flags.append(flagged(other, "BACKEND_DOCUMENT_ID_MISMATCH", "backend", "observed"))
    return hits, Z.together(*flags)


def failed(code: str = "BACKEND_FAILED") -> Callable[[DataFrame], DataFrame]:
    """flags with the failures of plans under the dispatcher's one code."""
    return lambda flags: flags.withColumn("code", F.when(F.col("code").isin("BACKEND_UNREACHABLE", "BACKEND_HTTP_ERROR"), code).otherwise(F.col("code")))
