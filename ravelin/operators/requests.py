"""Calls to a model at scale: equal prompts are asked once, replies are stored by key, few requests are in flight, failures are retried.

The key of a prompt is the SHA-256 of model, options and messages. Prompts are dealt by key into buckets;
a task asks for its buckets one after another, with IN_FLIGHT threads, each with a client of its own, and
puts the replies of each WAVE into a file for each bucket in the store. A task that is repeated, a plan that
runs twice, or a later job over other prompts reads the bucket's files first and asks only for what is not
there: what a lost task has asked for in vain is one wave at most. Errors are not stored, so another run asks again.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators import generation as G

IN_FLIGHT, WAVE, ATTEMPTS, PAUSE = 8, 64, 3, 0.5
#: Hexadecimal digits of the key that name a bucket: a task holds the replies of one bucket in 4096.
DIGITS = 3
REPLY = "key string, answer string, error string, prompt_tokens long, answer_tokens long"
STORED = pa.schema([("key", pa.string()), ("answer", pa.string()), ("prompt_tokens", pa.int64()), ("answer_tokens", pa.int64())])


class Refused(Exception):
    """What a client raises for a request that must not be sent again."""


class Counting(G.Echo):
    """The stand-in of generation, which counts white-space words as tokens."""

    def reply(self, messages: list[dict]) -> tuple[str, int, int]:
        said = super().reply(messages).strip()
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
        return said, sum(words(m["content"]) for m in messages), words(said)


def key(model: str, messages: Column, options: dict | None = None) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), F.lit(json.dumps(options or {}, sort_keys=True)).alias("options"), messages.alias("messages"))), 256)


class Bucket:
    """The stored replies of a bucket."""

    def __init__(self, store: str, name: str):
        from pyarrow import fs

        url = urlparse(store)
        self.fs, root = (fs.LocalFileSystem(), url.path) if url.scheme in ("", "file") else fs.FileSystem.from_uri(store)
        self.folder = f"{root}/bucket={name}"
        self.fs.create_dir(self.folder, recursive=True)
        files = [f.path for f in self.fs.get_file_info(fs.FileSelector(self.folder)) if f.path.endswith(".parquet")]
        self.known: dict[str, tuple] = {}
        for f in files:
            with self.fs.open_input_file(f) as raw:
                rows = pq.read_table(raw, schema=STORED).to_pydict()
            self.known |= {k: x for k, *x in zip(*rows.values())}

    def put(self, rows: list[tuple]) -> None:
        """A file of its own, under its final name at once."""
        name = f"{self.folder}/{uuid.uuid4().hex}"
        with self.fs.open_output_stream(f"{name}.part") as out:
            pq.write_table(pa.table([pa.array(x, t) for x, t in zip(zip(*rows), STORED.types)], schema=STORED), out)
        self.fs.move(f"{name}.part", f"{name}.parquet")
        self.known |= {k: x for k, *x in rows}


def ask(prompts: DataFrame, client: Callable[[], G.Client], store: str, model: str = "model", options: dict | None = None, in_flight: int = IN_FLIGHT, attempts: int = ATTEMPTS, pause: float = PAUSE, tasks: int | None = None) -> DataFrame:
    """(query_id string, answer, error, prompt_tokens, answer_tokens[, context_ids]) for prompts(query_id, messages[, context_ids]).

    store is a folder that driver and executors share. A client's reply is a text, or (text, prompt tokens, answer
    tokens); counts that it does not give are 0. At most in_flight requests are open in a task, so tasks x in_flight
    in all. Null or empty messages are not sent and give the error "no messages"; rows of one query_id are
    answered each. A prompt that half of all rows share is sent once.
    """
    if not model.strip():
        raise ValueError("model must not be empty")
    if in_flight < 1 or attempts < 1:
        raise ValueError("in_flight and attempts must be positive")

    def run(batches):
        mine = threading.local()

        def one(messages: list[dict]):
            for n in range(attempts):
                try:
                    if not hasattr(mine, "client"):
                        mine.client = client()
                    said = mine.client.reply(messages)
                    text, *counts = (said, 0, 0) if isinstance(said, str) else said
                    return (text.strip(), *(int(c or 0) for c in counts)), None
                except Refused as e:
                    return None, f"{type(e).__name__}: {e}"[:500]
                except Exception as e:  # whatever a client raises is this request's failure, not the job's
                    error = f"{type(e).__name__}: {e}"[:500]
                    if n + 1 < attempts:
                        time.sleep(pause * 2**n)
            return None, error

        held: dict[str, Bucket] = {}
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
                for at in range(0, len(rows), WAVE):
                    wave = rows[at : at + WAVE]
                    held = {b: held.get(b) or Bucket(store, b) for b in dict.fromkeys(r[0] for r in wave)}  # rows lie by bucket: many only where they are small
                    new = [r for r in wave if r[1] not in held[r[0]].known]
                    replies = dict(zip((r[1] for r in new), pool.map(one, [r[2] for r in new])))
                    for b, bucket in held.items():
                        good = [(k, *replies[k][0]) for x, k, _ in new if x == b and replies[k][1] is None]
                        if good:
                            bucket.put(good)
                    out = []
                    for b, k, _ in wave:
                        answer, *counts = held[b].known.get(k, (None, 0, 0))
                        out.append((k, answer, None if k in held[b].known else replies[k][1], *counts))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "answer", "error", "prompt_tokens", "answer_tokens"])

    more = [c for c in ("context_ids",) if c in prompts.columns]
    spoken = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    keyed = prompts.select(F.col("query_id").cast("string").alias("query_id"), spoken.alias("messages"), *more)
    keyed = keyed.withColumn("key", F.when(F.size("messages") > 0, key(model, F.col("messages"), options)))
    once = keyed.where("key is not null").select(F.substring("key", 1, DIGITS).alias("bucket"), "key", "messages").dropDuplicates(["key"])
    dealt = once.repartition(*([tasks] if tasks else []), "bucket").sortWithinPartitions("bucket")
    replies = dealt.mapInArrow(run, REPLY)
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return keyed.drop("messages").join(replies, "key", "left").select("query_id", "answer", F.when(F.col("key").isNull(), "no messages").otherwise(F.col("error")).alias("error"), count("prompt_tokens"), count("answer_tokens"), *more)


def problems(requests: DataFrame, max_top_k: int, max_budget: int, max_answer: int, document_id: str | None = None) -> DataFrame:
    """requests with a column problem: the first rule that requests(text, model, top_k, budget, answer, document_id) break, null if none.

    A null top_k, budget, answer or document_id leaves the default, so it breaks no rule.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    over = lambda c, most: (F.col(c) < 1) | (F.col(c) > most)
    other = F.col("document_id") != F.lit(document_id) if document_id is not None else F.lit(False)
    rule = F.when(blank("text"), "QUERY_EMPTY").when(over("top_k", max_top_k), "TOP_K_OUT_OF_RANGE").when(F.col("model").isNotNull() & blank("model"), "MODEL_EMPTY").when(F.col("budget") > max_budget, "BUDGET_TOO_LARGE").when(over("answer", max_answer), "ANSWER_TOKENS_OUT_OF_RANGE").when(other, "DOCUMENT_MISMATCH")
    return requests.withColumn("problem", rule)
