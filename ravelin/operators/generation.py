"""Context, prompts, token budgets, abstention, and pluggable model clients."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM_PROMPT = "Answer the question from the given context only, briefly and precisely. If the context does not hold the answer, say so."
NO_CONTEXT = "No context provided."
MIN_HITS, MIN_RRF, MIN_DUAL = 2, 0.015, 1
BUDGET, ANSWER, OVERHEAD = 2048, 384, 320


def formatted(texts: Column) -> Column:
    """[1] first, [2] second, ... with a blank line between."""
    body = F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n\n")
    return F.when(F.size(texts) > 0, body).otherwise(NO_CONTEXT)


def messages(query: Column, texts: Column, system: str = SYSTEM_PROMPT) -> Column:
    user = F.concat(F.lit("Context:\n"), formatted(texts), F.lit("\n\nQuestion: "), query)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def preview(source: Column, chunk: Column, rank: Column, label: Column | None = None, title: Column | None = None, page: Column | None = None) -> Column:
    part = lambda name, c: F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{name}="), c.cast("string")))
    more = [part(n, c) for n, c in (("section_label", label), ("section_title", title), ("page", page)) if c is not None]
    return F.concat_ws("; ", F.concat(F.lit("source_type="), source), F.concat(F.lit("chunk_id="), chunk.cast("string")), F.concat(F.lit("rank="), rank.cast("string")), *more)


def budgeted(hits: DataFrame, budget: int = BUDGET - ANSWER - OVERHEAD) -> DataFrame:
    """hits(query_id, rank, head, text) that fit a token budget, in order: whole, else cut to what is left, else stop.

    Counts are of white-space words. At most a few hundred hits of a query are folded in one row.
    """
    if budget < 128:
        raise ValueError("the context budget must be 128 tokens or more")
    words = lambda c: F.filter(F.split(c, r"\s+", -1), lambda x: x != "")
    rows = hits.where(F.trim("text") != "").select("query_id", F.struct("rank", words(F.col("text")).alias("w"), F.size(words(F.concat_ws(" ", F.lit("[CONTEXT]"), "head", F.lit("text:")))).alias("h")).alias("x"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    state = F.struct(F.lit(0).alias("used"), F.lit(False).alias("done"), F.array().cast("array<struct<rank:int,tokens:int,text:string,truncated:boolean>>").alias("out"))

    def step(a, x):
        full = x["h"] + F.size(x["w"])
        left = F.lit(budget) - a["used"]
        body = left - x["h"] - 1
        fits = full <= left
        stop = a["done"] | (~fits & ((left <= 32) | (body < 16)))
        n = F.when(fits, F.size(x["w"])).otherwise(F.least(body, F.size(x["w"])))
        took = F.struct(x["rank"].cast("int").alias("rank"), (x["h"] + n).cast("int").alias("tokens"), F.array_join(F.slice(x["w"], 1, F.greatest(n, F.lit(1))), " ").alias("text"), (~fits).alias("truncated"))
        return F.struct(F.when(stop, a["used"]).otherwise(a["used"] + x["h"] + n).alias("used"), stop.alias("done"), F.when(stop, a["out"]).otherwise(F.array_append(a["out"], took)).alias("out"))

    return lists.select("query_id", F.inline(F.aggregate("xs", state, step)["out"]))


def abstention(queries: DataFrame, hits: DataFrame, flags: DataFrame | None = None, min_hits: int = MIN_HITS, min_rrf: float = MIN_RRF, min_dual: int = MIN_DUAL) -> DataFrame:
    """(query_id, abstain, reason) before any model call, by the first rule that holds."""
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rrf_score").alias("best"), F.count_if(F.col("sparse_rank").isNotNull() & F.col("vector_rank").isNotNull()).alias("dual"))
    q = queries.select("query_id").join(per, "query_id", "left")
    if flags is not None:
        f = flags.groupBy("query_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("code").isin("BACKEND_UNREACHABLE", "BACKEND_HTTP_ERROR")).alias("lost"))
        q = q.join(f, "query_id", "left")
    else:
        q = q.withColumns({"errors": F.lit(0), "lost": F.lit(0)})
    reason = F.when(F.col("n").isNull(), "NO_RETRIEVAL_HITS").when(F.col("errors") > 0, "RETRIEVAL_ERROR_FLAG").when(F.col("lost") > 0, "RETRIEVAL_BACKEND_DEGRADED").when(F.col("n") < min_hits, "NOT_ENOUGH_HITS").when(F.col("best") < min_rrf, "LOW_RELEVANCE_SCORE").when(F.col("dual") < min_dual, "INSUFFICIENT_DUAL_BACKEND_EVIDENCE")
    return q.select("query_id", reason.isNotNull().alias("abstain"), reason.alias("reason"))


def json_object(c: Column) -> Column:
    """The whole text as JSON, else what lies from the first { to the last }; null if neither parses."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(F.when(F.trim(c).startswith("{") & F.try_parse_json(c).isNotNull(), F.trim(c)), F.when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner))


class Client:
    """What a model must offer: one reply for a list of messages."""

    def reply(self, messages: list[dict]) -> str:
        raise NotImplementedError


class Echo(Client):
    """A deterministic stand-in: the first context line, or the refusal."""

    def reply(self, messages: list[dict]) -> str:
        user = messages[-1]["content"]
        return NO_CONTEXT if NO_CONTEXT in user else user.split("\n")[1][:200]


def generate(prompts: DataFrame, client: Callable[[], Client] = Echo) -> DataFrame:
    """(query_id, answer, error) for prompts(query_id, messages), in Arrow batches; a failed call gives an error, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for b in batches:
            out = []
            for m in b["messages"]:
                try:
                    out.append((model.reply([dict(zip(("role", "content"), x.values() if isinstance(x, dict) else x)) for x in m]).strip(), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, str(e)))
            yield pd.DataFrame({"query_id": b["query_id"].astype(str), "answer": [a for a, _ in out], "error": [e for _, e in out]})

    return prompts.select(F.col("query_id").cast("string").alias("query_id"), "messages").mapInPandas(run, "query_id string, answer string, error string")
