"""Calls to a model: counted by a client that leaves a file for each call."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from ravelin.operators import answering as A
from ravelin.operators import generation as G
from ravelin.operators import requests as R

PROMPT = "query_id string, messages array<struct<role:string,content:string>>, context_ids array<long>"


def noting(folder, failing=(), refused=()):
    """A client that notes each call; the first call of a failing content is an error, each of a refused one."""

    class Noting(G.Client):
        def reply(self, messages):
            said = messages[-1]["content"]
            before = sum(f.startswith(f"{said}-") for f in os.listdir(folder))
            open(f"{folder}/{said}-{uuid.uuid4().hex}", "w").close()
            if said in refused:
                raise R.Refused("no")
            if said in failing and before < failing[said]:
                raise OSError("busy")
            return (f" re {said} ", 3, None) if said == "a" else f"re {said}"

    return Noting


def calls(folder):
    return sorted(f.split("-")[0] for f in os.listdir(folder))


def rows(spark, contents):
    return spark.createDataFrame([(str(i), None if c is None else [("system", "s"), ("user", c)] if c else [], [i, 7]) for i, c in enumerate(contents)], PROMPT)


def test_equal_prompts_are_asked_once_and_never_again(spark, tmp_path):
    notes, store = tmp_path / "notes", str(tmp_path / "store")
    notes.mkdir()
    prompts = rows(spark, ["a"] * 50 + ["b", "c", None, ""])
    ask = lambda p, model="m", **more: R.ask(p, noting(notes), store, model, pause=0, **more)
    got = {r.query_id: r for r in ask(prompts).collect()}
    assert calls(notes) == ["a", "b", "c"] and len(got) == 54
    assert (got["0"].answer, got["0"].prompt_tokens, got["0"].answer_tokens, got["0"].context_ids) == ("re a", 3, 0, [0, 7])
    assert got["49"].answer == "re a" and got["50"].answer == "re b" and (got["52"].error, got["53"].error, got["53"].answer) == ("no messages", "no messages", None)
    assert ask(prompts).count() == 54 and ask(rows(spark, ["c", "d"]), tasks=2).where("answer is null").count() == 0
    assert calls(notes) == ["a", "b", "c", "d"]
    ask(rows(spark, ["a"]), "another").collect()
    ask(rows(spark, ["a"]), options={"temperature": 0.5}).collect()
    assert calls(notes) == ["a", "a", "a", "b", "c", "d"]
    assert ask(rows(spark, [])).count() == 0


def test_failures_are_retried_and_not_stored(spark, tmp_path):
    notes, store = tmp_path / "notes", str(tmp_path / "store")
    notes.mkdir()
    prompts = rows(spark, ["a", "b", "c", "d"])
    ask = lambda: {r.query_id: (r.answer, r.error) for r in R.ask(prompts, noting(notes, {"b": 2, "c": 3}, {"d"}), store, attempts=3, pause=0).collect()}
    assert ask() == {"0": ("re a", None), "1": ("re b", None), "2": (None, "OSError: busy"), "3": (None, "Refused: no")}
    assert calls(notes) == ["a", "b", "b", "b", "c", "c", "c", "d"]
    assert ask()["2"] == ("re c", None)
    assert calls(notes) == ["a", "b", "b", "b", "c", "c", "c", "c", "d", "d"]


def test_what_a_lost_task_has_stored_is_not_asked_again(spark, tmp_path, monkeypatch):
    """A wave is stored before the next one is sent; an unfinished file is not read."""
    notes, store = tmp_path / "notes", str(tmp_path / "store")
    notes.mkdir()
    prompts = rows(spark, [f"p{i}" for i in range(30)])
    half = [r["k"] for r in prompts.select(R.key("m", F.col("messages")).alias("k")).limit(12).collect()]
    for k in half:
        R.Bucket(store, k[: R.DIGITS]).put([(k, "kept", 1, 1)])
        open(f"{store}/bucket={k[: R.DIGITS]}/x.part", "w").close()
    got = R.ask(prompts, noting(notes), store, "m", in_flight=3).collect()
    assert len(calls(notes)) == 18 and sum(r.answer == "kept" for r in got) == 12


def test_answers_and_flags_ask_the_model_once(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()

    class Yes(G.Client):
        def reply(self, messages):
            open(f"{notes}/{uuid.uuid4().hex}", "w").close()
            return '{"answer": "yes", "should_abstain": false, "confidence": "high", "reasoning": "r"}'

    questions = spark.createDataFrame([(1, "q one"), (2, "q two")], "query_id long, text string")
    hits = spark.createDataFrame([(q, r, "s", 10 * q + r, f"text {q} {r}", 0.5, 1, 1) for q in (1, 2) for r in (1, 2)], "query_id long, rank int, source_type string, chunk_id long, text string, rrf_score double, sparse_rank int, vector_rank int")
    answers, flags = A.answered(questions, hits, None, Yes, ask=lambda p: R.ask(p, Yes, str(tmp_path / "store"), "m"))
    assert [r.answer for r in answers.collect()] == ["yes", "yes"] and flags.where("code = 'LLM_REASONING'").count() == 2
    assert len(os.listdir(notes)) == 2


def test_requests_are_checked(spark):
    made = [("q", "m", 3, 500, 50, "d"), (" ", "m", 3, 500, 50, "d"), ("q", " ", 3, 500, 50, "d"), ("q", "m", 0, 500, 50, "d"), ("q", "m", 99, 500, 50, "d"), ("q", "m", 3, 9999, 50, "d"), ("q", "m", 3, 500, 0, "d"), ("q", "m", 3, 500, 50, "e"), ("q", None, None, None, None, None), (None, None, None, None, None, None)]
    got = R.problems(spark.createDataFrame(made, "text string, model string, top_k int, budget int, answer int, document_id string").coalesce(1), 20, 4096, 512, "d")
    assert [r.problem for r in got.collect()] == [None, "QUERY_EMPTY", "MODEL_EMPTY", "TOP_K_OUT_OF_RANGE", "TOP_K_OUT_OF_RANGE", "BUDGET_TOO_LARGE", "ANSWER_TOKENS_OUT_OF_RANGE", "DOCUMENT_MISMATCH", None, "QUERY_EMPTY"]
    with pytest.raises(ValueError):
        R.ask(rows(spark, ["a"]), G.Echo, "/tmp/none", " ")
