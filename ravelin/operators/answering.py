"""From ranked hits to answers: limits, abstention before and after the model, JSON replies, and what went wrong as flags."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators import flags as Z
from ravelin.operators import generation as G

#: The fields of a reply; the prompt is made from it.
SCHEMA = {"type": "object", "properties": {"answer": {"type": "string"}, "should_abstain": {"type": "boolean"}, "confidence": {"enum": ["low", "medium", "high"]}, "reasoning": {"type": "string"}}, "required": ["answer", "should_abstain", "confidence", "reasoning"]}
INSTRUCTIONS = f"Reply with one JSON object of this schema: {json.dumps(SCHEMA)}. Set should_abstain where the quoted passages do not settle the question."
REFUSAL = "Dazu kann ich auf Grundlage der vorliegenden Dokumente keine verlässliche Auskunft geben."
REPLY = "answer string, should_abstain boolean, confidence string, reasoning string"
LEAST_BUDGET = 128


@dataclass(frozen=True)
class Limits:
    """When to abstain and how long contexts and answers may be. A field of an override that is None leaves the default."""

    min_hits: int | None = G.MIN_HITS
    min_rrf: float | None = G.MIN_RRF
    min_dual: int | None = G.MIN_DUAL
    on_errors: bool | None = True
    on_degradation: bool | None = True
    on_low_confidence: bool | None = True
    top_k: int | None = 10
    budget: int | None = G.BUDGET
    answer: int | None = G.ANSWER
    overhead: int | None = G.OVERHEAD

    def overridden(self, by: "Limits | None", mode: str = "hybrid") -> "Limits":
        """The limits of a request; a mode of one backend asks for no evidence of both."""
        given = {k: v for k, v in vars(by).items() if v is not None} if by else {}
        return replace(self, **given | ({} if mode == "hybrid" else {"min_dual": 0}))

    def context(self) -> int:
        room = self.budget - self.answer - self.overhead
        if self.top_k < 1 or self.answer < 1:
            raise ValueError("top_k and the answer's tokens must be positive")
        if room < LEAST_BUDGET:
            raise ValueError("the token budget leaves too little for the context")
        return room


NO_OVERRIDE = Limits(*[None] * 10)


def prompts(question: Column, context: Column) -> Column:
    user = F.concat(context, F.lit("\n\nQuestion: "), F.trim(question))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(INSTRUCTIONS).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


class JsonClient(G.Client):
    """Replies by a schema; a server that refuses it (a status of 400 or more) is asked for plain JSON.

    send(messages, format) gives (status, content).
    """

    SCHEMA = SCHEMA

    def __init__(self, send: Callable[[list[dict], object], tuple[int, str]]):
        self.send = send

    def reply(self, messages: list[dict]) -> str:
        for form in (self.SCHEMA, "json"):
            status, content = self.send(messages, form)
            if status < 400:
                return content
        raise RuntimeError(f"the model answered with status {status}")


def answered(questions: DataFrame, hits: DataFrame, retrieval_flags: DataFrame | None, client: Callable[[], G.Client], limits: Limits = Limits(), ask: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, flags) for questions(query_id, text) and hits(query_id, rank, source_type, chunk_id, text, rrf_score, sparse_rank, vector_rank).

    Only questions that no rule stops before reach the model. ask, if given, answers prompts(query_id, messages) in
    place of the client: with requests.ask, whose replies are stored, answers and flags ask the model once between them.
    """
    room = limits.context()
    top = hits.where(F.col("rank") <= limits.top_k)
    seen = None
    if retrieval_flags is not None:
        lost = F.col("code").isin("BACKEND_UNREACHABLE", "BACKEND_HTTP_ERROR")
        seen = retrieval_flags.where(F.lit(limits.on_errors) & (F.col("severity") == "error") & ~lost | F.lit(limits.on_degradation) & lost)
    before = G.abstention(questions, top, seen, limits.min_hits, limits.min_rrf, limits.min_dual).select("query_id", F.col("reason").alias("before"))
    head = G.preview(F.col("source_type"), F.col("chunk_id"), F.col("rank"))
    used = G.budgeted(top.select("query_id", "rank", head.alias("head"), "text"), room).join(top.select("query_id", "rank", "source_type", "chunk_id", head.alias("head")), ["query_id", "rank"])
    piece = F.concat(F.lit("[CONTEXT] "), F.col("head"), F.lit("\ntext: "), F.col("text"), F.lit("\n"))
    own = used.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_type", "chunk_id", "truncated", piece.alias("piece")))).alias("chunks"), F.sum("tokens").alias("used_tokens"))
    counts = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("hit_count"))
    asked = questions.join(before, "query_id").join(own, "query_id", "left").join(counts, "query_id", "left").fillna(0, ["used_tokens", "hit_count"])
    asked = asked.withColumn("before", F.coalesce("before", F.when(F.col("chunks").isNull(), "NO_CONTEXT_CHUNKS"))).withColumn("query_key", F.col("query_id").cast("string"))
    block = F.trim(F.array_join(F.transform("chunks", lambda x: x["piece"]), "\n"))
    wanted = asked.where("before is null").select("query_id", prompts(F.col("text"), block).alias("messages"))
    replies = (ask(wanted) if ask else G.generate(wanted, client)).select("query_id", "answer", "error").withColumnRenamed("query_id", "query_key").withColumnRenamed("answer", "raw")
    all_ = asked.join(replies, "query_key", "left").withColumn("j", F.from_json(G.json_object(F.coalesce("raw", F.lit(""))), REPLY))
    j = F.col("j")
    valid = j.isNotNull() & j["answer"].isNotNull() & j["should_abstain"].isNotNull()
    low = F.lit(limits.on_low_confidence) & (F.lower(F.coalesce(j["confidence"], F.lit(""))) == "low")
    reason = F.coalesce(F.col("before"), F.when(F.col("error").isNotNull(), "LLM_CALL_FAILED").when(~valid, "LLM_OUTPUT_INVALID").when(low, "LOW_LLM_CONFIDENCE").when(j["should_abstain"], "LLM_ABSTAINED"))
    said = F.nullif(F.trim(j["answer"]), F.lit(""))
    made = all_.withColumn("reason", reason).withColumn("reasoning", F.when(F.col("before").isNull() & F.col("error").isNull() & valid, F.coalesce(F.nullif(F.trim(j["reasoning"]), F.lit("")), F.lit("structured reply")))).withColumn("confidence", j["confidence"])
    flags = Z.together(
        Z.flagged(made.where("chunks is null"), "generator", "CONTEXT_EMPTY_AFTER_BUDGETING", "query_id"),
        Z.flagged(made.where("before is null and reason in ('LLM_CALL_FAILED', 'LLM_OUTPUT_INVALID')"), "generator", F.col("reason"), "query_id", "error"),
        Z.flagged(made.where("reasoning is not null"), "generator", "LLM_REASONING", "query_id", "confidence", "reasoning"),
    )
    answers = made.select("query_id", F.when(F.col("reason").isNull(), F.coalesce(said, F.lit(REFUSAL))).otherwise(REFUSAL).alias("answer"), F.col("reason").isNotNull().alias("abstained"), "reason", "hit_count", "used_tokens", F.coalesce(F.transform("chunks", lambda x: F.struct(x["rank"], x["source_type"], x["chunk_id"], x["truncated"])), F.array()).alias("used_chunks"))
    return answers, flags


def chat(questions: DataFrame, search: Callable[[DataFrame], tuple[DataFrame, DataFrame]], sources: list[str] | None, client: Callable[[], G.Client], limits: Limits = Limits(), override: Limits | None = None, mode: str = "hybrid", ask: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, flags): search gives (hits, flags) of the questions; hits of other sources than those wanted are left out."""
    hits, found = search(questions)
    wanted = hits if sources is None else hits.where(F.col("source_type").isin(*sources))
    answers, flags = answered(questions, wanted, found, client, limits.overridden(override, mode), ask)
    return answers, flags.unionByName(found.select(F.lit("retrieval").alias("stage"), "code", "severity", F.lit("{}").alias("context")))
