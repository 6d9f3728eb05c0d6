"""Retrieval and generation metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators.generation import generate, messages
from ravelin.operators.retrieval import Index, _cuts, ranked, remainder_scores
from ravelin.sources.store import written

#: Words of a key of passages, bytes of texts that are hashed at once, and the base of the hashes, an odd number.
KEY_WORDS, KEY_BYTES, BASE = 6, 1 << 20, 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... in 64 bits."""
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64)))


def keys(rows: DataFrame, id_col: str) -> DataFrame:
    """(id_col, at, key): hashes of the bytes of all six words in a row of rows(id_col, text), white space between them included; at counts from 0. Words lie between ASCII white space."""

    def run(batches):
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        up, down = (_powers(x, KEY_BYTES) for x in (BASE, pow(BASE, -1, 1 << 64)))
        for batch in batches:
            texts = pa.concat_arrays([batch.column(1).cast(pa.large_binary()).fill_null(b"")])
            ends = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))).astype(np.int64)
            for a, b in _cuts(np.diff(ends), len(texts), KEY_BYTES):
                raw = np.frombuffer(b"".join(texts.slice(a, b - a).to_pylist()), np.uint8)
                if len(raw) >= len(up):  # one text of more bytes
                    up, down = (_powers(x, len(raw)) for x in (BASE, pow(BASE, -1, 1 << 64)))
                begins = np.zeros(len(raw) + 1, bool)
                begins[ends[a : b + 1] - ends[a]] = True
                blank = space[raw]
                starts = np.flatnonzero(~blank & (np.append(True, blank)[:-1] | begins[:-1]))
                stops = np.flatnonzero(~blank & (np.append(blank, True)[1:] | begins[1:])) + 1
                of = np.searchsorted(ends[a : b + 1] - ends[a], starts, "right") - 1
                at = np.arange(len(of)) - np.searchsorted(of, of)
                on = np.flatnonzero(of[: len(of) - KEY_WORDS + 1] == of[KEY_WORDS - 1 :]) if len(of) >= KEY_WORDS else np.zeros(0, np.int64)
                sums = np.append(np.uint64(0), np.cumsum((raw + np.uint64(1)) * up[: len(raw)]))
                key = (sums[stops[on + KEY_WORDS - 1]] - sums[starts[on]]) * down[starts[on]]  # the same wherever the words lie
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + of[on])), pa.array(at[on]), pa.array(key.view(np.int64))], [id_col, "at", "key"])

    return rows.select(id_col, "text").mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, at long, key long")


def holding(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, chunk_id): the chunks(chunk_id, text) that hold the text of passages(query_id, text).

    A chunk that holds a passage shares its second to seventh word; the first may begin inside a word of the chunk and the
    last may end in one. Only keys travel; texts are joined to what meets. Every chunk is searched for passages
    of fewer than eight words. The pairs are stored, as plans read them several times.
    """
    asked = keys(passages, "query_id").where("at in (1, 2)").groupBy("query_id").agg(F.max(F.when(F.col("at") == 1, F.col("key"))).alias("key"), F.max("at").alias("last"))
    asked = written(asked.where("last = 2").select("query_id", "key"), "passages")
    met = written(keys(chunks, "chunk_id").join(asked, "key").select("query_id", "chunk_id").distinct(), "met")
    own, text = passages.select("query_id", F.col("text").alias("passage")), chunks.select("chunk_id", "text")
    few = own.join(asked, "query_id", "left_anti")
    return written(text.join(met, "chunk_id").join(own, "query_id").unionByName(few.crossJoin(text)).where(F.contains("text", "passage")).select("query_id", "chunk_id"), "relevant")


def per_query(questions: DataFrame, hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, rr) for every question with relevant chunks; precision divides by k, rr looks at the whole list."""
    judged = hits.select("query_id", "chunk_id", "rank").join(relevant.select("query_id", "chunk_id").withColumn("rel", F.lit(1)), ["query_id", "chunk_id"], "left")
    found = judged.groupBy("query_id").agg(F.count_if((F.col("rel") == 1) & (F.col("rank") <= k)).alias("hit"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    want = relevant.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("want"))
    q = questions.select("query_id").join(want, "query_id").join(found, "query_id", "left")
    hit = F.coalesce("hit", F.lit(0))
    return q.select("query_id", (hit / k if k > 0 else F.lit(0.0)).alias("precision"), (hit / F.col("want")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def macro(metrics: DataFrame, k: int) -> DataFrame:
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return metrics.agg(F.count(F.lit(1)).alias("num_queries"), zero("precision").alias("precision_at_k"), zero("recall").alias("recall_at_k"), zero("rr").alias("mrr")).withColumn("k", F.lit(k))


def distractors(questions: DataFrame, ix: Index, relevant: DataFrame, n: int) -> DataFrame:
    """For each question with relevant chunks, the n best hits above 0 of an index of all other chunks."""
    asked = questions.join(relevant.select("query_id").distinct(), "query_id", "left_semi")
    return ranked(remainder_scores(asked, ix, relevant, n), n)


def context_grid(relevant: DataFrame, noise: DataFrame, levels: list[int]) -> DataFrame:
    """(query_id, level, place, chunk_id): relevant chunks and the first `level` distractors, in a stable shuffled order."""
    spark = relevant.sparkSession
    wanted = spark.createDataFrame([(x,) for x in sorted(set(levels))], "level int")
    own = relevant.select("query_id", "chunk_id").distinct().crossJoin(F.broadcast(wanted))
    other = noise.select("query_id", "chunk_id", "rank").crossJoin(F.broadcast(wanted)).where("rank <= level").drop("rank")
    asked = relevant.select("query_id").distinct()
    rows = own.unionByName(other.join(asked, "query_id", "left_semi"))
    order = F.md5(F.concat_ws("|", "query_id", "level", "chunk_id").cast("binary"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "level").orderBy(order)))


def judgement(c: Column) -> Column:
    """(correct, confidence, reasoning) of a judge's reply: fences stripped, JSON, else a search for a true verdict."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*|\s*```$", ""))
    js = F.from_json(bare, "correct boolean, confidence string, reasoning string")
    ok = F.try_parse_json(bare).isNotNull() & bare.startswith("{")
    said = F.regexp_replace(F.lower(c), r"\s+", "").contains('"correct":true')
    return F.when(ok, F.struct(F.coalesce(js["correct"], F.lit(False)).alias("correct"), F.coalesce(F.expr("1D") * js["confidence"].try_cast("double"), F.lit(0.5)).alias("confidence"), F.coalesce(js["reasoning"], F.lit("")).alias("reasoning"))).otherwise(F.struct(said.alias("correct"), F.lit(0.5).alias("confidence"), c.alias("reasoning")))


def accuracy(results: DataFrame) -> DataFrame:
    """(level, accuracy, questions): by level, and overall where level is null."""
    return results.rollup("level").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.countDistinct("query_id").alias("questions"))


# ---- whole runs -----------------------------------------------------------------------------------

JUDGE_PROMPT = "You compare an answer with a reference answer to the same question. Reply with a JSON object: correct (true or false), confidence (0 to 1), reasoning."


def retrieval_report(questions: DataFrame, hits: DataFrame, relevant: DataFrame, k: int, retriever: str, corpus_size: int) -> DataFrame:
    """One row: the macro metrics of a retriever, with what they were measured on. Questions without relevant chunks do not count."""
    asked = questions if "expected_abstention" not in questions.columns else questions.where(~F.coalesce("expected_abstention", F.lit(False)))
    return macro(per_query(asked, hits, relevant, k), k).select(F.lit(retriever).alias("retriever"), F.lit(corpus_size).alias("corpus_size"), "*")


def skipped(questions: DataFrame, relevant: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, why) of the questions a generation run leaves out: abstention expected, no text, or no relevant chunk that exists."""
    known = relevant.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("query_id").distinct().withColumn("known", F.lit(True))
    expected = F.coalesce("expected_abstention", F.lit(False)) if "expected_abstention" in questions.columns else F.lit(False)
    why = F.when(expected, "ABSTENTION_EXPECTED").when(F.trim(F.coalesce("text", F.lit(""))) == "", "EMPTY_QUESTION").when(F.col("known").isNull(), "NO_RELEVANT_CHUNK")
    return questions.join(known, "query_id", "left").select("query_id", why.alias("why")).where("why is not null")


def generation_run(questions: DataFrame, relevant: DataFrame, noise: DataFrame, chunks: DataFrame, levels: list[int], client, judge) -> DataFrame:
    """(query_id, level, answer, error, correct, confidence, reasoning) of every question left and every level of distractors.

    questions(query_id, text, reference_answer); client and judge make the model clients (see generation).
    """
    asked = questions.join(skipped(questions, relevant, chunks), "query_id", "left_anti")
    own = relevant.join(asked.select("query_id"), "query_id", "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    placed = context_grid(own, noise, levels).join(chunks.select("chunk_id", "text"), "chunk_id")
    lists = placed.groupBy("query_id", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("ctx"))
    rows = lists.join(asked, "query_id").withColumn("run", F.concat_ws("|", F.col("query_id").cast("string"), F.col("level").cast("string")))
    replies = generate(rows.select(F.col("run").alias("query_id"), messages(F.col("text"), F.col("ctx")).alias("messages")), client).withColumnRenamed("query_id", "run")
    said = rows.join(replies, "run")
    case = F.concat(F.lit("Question: "), "text", F.lit("\nReference answer: "), F.coalesce("reference_answer", F.lit("")), F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")))
    ask = F.array(F.struct(F.lit("system").alias("role"), F.lit(JUDGE_PROMPT).alias("content")), F.struct(F.lit("user").alias("role"), case.alias("content")))
    verdicts = generate(said.where("answer is not null").select(F.col("run").alias("query_id"), ask.alias("messages")), judge).select(F.col("query_id").alias("run"), F.col("answer").alias("reply"))
    j = judgement(F.coalesce("reply", F.lit("")))
    return said.join(verdicts, "run", "left").withColumn("j", j).select("query_id", "level", "answer", "error", "j.*")


def generation_report(results: DataFrame, model: str, judge: str, levels: list[int]) -> DataFrame:
    """One row: accuracy overall and by level of distractors, with the run's configuration."""
    by = accuracy(results)
    return by.agg(F.max(F.when(F.col("level").isNull(), F.col("accuracy"))).alias("accuracy"), F.max(F.when(F.col("level").isNull(), F.col("questions"))).alias("questions"), F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "accuracy")))).alias("by_level")).select(F.lit(model).alias("model"), F.lit(judge).alias("judge"), F.lit(sorted(set(levels))).alias("levels"), "*")
