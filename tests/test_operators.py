"""Literal inputs and outputs of the retrieval pipeline's operators, and the registered queries against DuckDB."""

import hashlib
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import chunking as C
from ravelin.operators import evaluation as V
from ravelin.operators import extraction as E
from ravelin.operators import faq as Q
from ravelin.operators import generation as G
from ravelin.operators import retrieval as R
from ravelin.plans import registry

SMALL = [("c1", 0, "The master thesis has 30 credits."), ("c2", 1, "Examination rules and grading policy."), ("c3", 2, "Study abroad in the third semester.")]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("query", "expected"), [("thesis", [("c1", 0.497652)]), ("study", [("c3", 0.497652)]), ("master thesis credits", [("c1", 0.995305)]), ("the", [("c1", 0.108861), ("c3", 0.108861)]), ("", []), ("absent", [])])
def test_bm25_golden(spark, query, expected):
    ix = R.index(spark.createDataFrame(SMALL, "chunk_id string, pos int, text string"))
    hits = R.bm25(spark.createDataFrame([(1, query)], "query_id int, text string"), ix).orderBy("rank").collect()
    assert [(h.chunk_id, round(h.score, 6)) for h in hits] == expected


def test_bm25_half_of_documents_scores_nothing(spark):
    ix = R.index(spark.createDataFrame([("a", 0, "alpha beta gamma"), ("b", 1, "delta epsilon zeta")], "chunk_id string, pos int, text string"))
    assert R.bm25(spark.createDataFrame([(1, "alpha")], "query_id int, text string"), ix).count() == 0


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("a  b\tc\nd"))) == ["a", "b", "c", "d"]
    assert "§23?" in one(spark, T.tokens(F.lit("What is §23?")))
    assert one(spark, T.tokens(F.lit(""))) == []
    assert one(spark, T.tokens_german(F.lit("Die Regel in § 23a und 7 x"))) == ["regel", "paragraf", "23a", "7"]


def hits(spark, rows):
    return spark.createDataFrame([(1, c, i, i + 1, s) for i, (c, s) in enumerate(rows)], "query_id int, chunk_id string, pos int, rank int, score double")


def test_rrf(spark):
    fused = R.rrf([hits(spark, [("c1", 3.0), ("c2", 2.0)]), hits(spark, [("c1", 0.9), ("c3", 0.8)])]).orderBy("rank").collect()
    assert [x.chunk_id for x in fused] == ["c1", "c2", "c3"]
    assert R.rrf([hits(spark, [("c1", 1.0)]), hits(spark, [("c1", 1.0)])], constant=1).first().score == 1.0
    with pytest.raises(ValueError, match="exactly 2"):
        R.rrf([hits(spark, [("c1", 1.0)])])


def test_dense_scores_and_ties(spark):
    v = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [2.0, 0.0]), ("c", 2, [0.0, -1.0])], "chunk_id string, pos int, embedding array<float>")
    got = R.dense(spark.createDataFrame([(1, [3.0, 0.0])], "query_id int, embedding array<float>"), v, 9).orderBy("rank").collect()
    assert [(x.chunk_id, x.score) for x in got] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]


def test_windows():
    assert C.windows([2, 2, 2], 100, 10) == [(0, 3)]
    assert C.windows([10, 10, 25], 30, 10) == [(0, 2), (1, 2), (2, 3)]
    rng = random.Random(1)
    for _ in range(200):
        counts = [rng.randint(1, 12) for _ in range(rng.randint(0, 40))]
        got = C.windows(counts, 20, rng.randint(0, 15))
        assert all(b == len(counts) for _, b in got[-1:]) and {i for a, b in got for i in range(a, b)} == set(range(len(counts)))
        assert all(x[0] < y[0] for x, y in zip(got, got[1:]))


def test_merged_and_packed():
    size = lambda s: len(s.split())
    assert C.merged(["a", "b c d", "e"], 2, 10, size) == ["a b c d e"]
    assert C.merged(["a", "b", "c d"], 2, 3, size) == ["a b", "c d"]
    assert C.merged(["a"], 5, 10, size) == ["a"]
    assert C.merged(["a", "b", "c", "d e f"], 3, 10, size) == ["a b c", "d e f"]
    assert C.merged(["a b c", "d", "e f g h"], 2, 4, size) == ["a b c d", "e f g h"]
    assert C.merged(["a b c d", "e", "f g h i"], 2, 4, size) == ["a b c d", "e", "f g h i"]
    assert C.packed_rows(["a b c d e"], [["x y"], ["z"]], 5, size) == [["x y", "z"]]  # a header without room for rows is dropped
    assert C.packed_rows(["a"], [["x y"], ["z"], ["1 2 3 4 5 6"], ["w"]], 5, size) == [["a", "x y"], ["a", "z"], ["1 2 3 4 5 6"], ["a", "w"]]
    assert C.packed_rows(["a"], [["x y z w"]], 5, size) == [["a", "x y z w"]]
    rows = [[f"CS {i}", "", "elective"] for i in range(100)]
    packs = C.packed_rows(["code", "kind"], rows, 50, size)
    assert len(packs) > 1 and all(p[0] == "code | kind" for p in packs) and sum(len(p) - 1 for p in packs) == 100
    assert C.packed_rows([], [], 50, size) == []


def test_chunks_bounds(spark):
    text = " ".join(f"Word{i} and more of it here." for i in range(200)) + " " + "x " * 300
    d = spark.createDataFrame([("d", "s", "Head", text), ("d", "e", "", "")], "doc_id string, section_id string, heading string, text string")
    got = C.chunk_sections(d, 64, 8, 10).collect()
    assert max(x.token_count for x in got) <= 64 and len({x.chunk_id for x in got}) == len(got) and all(x.text.startswith("Head\n\n") for x in got)
    assert C.section_flags(d).collect()[0].section_id == "e"


def test_page_text(spark):
    assert one(spark, T.without_page_number(F.lit("3\nContent here"), F.lit(3))) == "Content here"
    assert one(spark, T.without_page_number(F.lit("3\nContent here"), F.lit(1))) == "3\nContent here"
    assert one(spark, T.tidy(F.lit("a\n\n\n\nb"))) == "a\n\nb"
    assert one(spark, T.tidy(F.lit("hello   \nworld  "))) == "hello\nworld"
    assert len(one(spark, T.sentences(F.lit("First sentence. Second sentence. Third one.")))) == 3


def test_table_rows(spark):
    assert one(spark, E.is_header(F.array(F.lit("Name of module"), F.lit("x"))))
    assert one(spark, E.is_label(F.array(F.lit("Compulsory Elective Modules"), F.lit(""))))
    assert not one(spark, E.is_label(F.array(F.lit("CS 627 Advanced Algorithms"), F.lit("9"))))


def test_faq(spark):
    rows = [("s", 0, "1", "  What?  ", "  Answer.  "), ("s", 1, "", "q", "a"), ("s", 2, "2", "", "a"), ("s", 3, "1", "q", "a"), ("s", 4, "3", "q", None), ("s", 5, "2", "q", "a")]
    e = spark.createDataFrame(rows, "faq_source string, pos int, id string, question string, answer string")
    assert [r.text for r in Q.chunks(e).orderBy("pos").collect()] == ["Question: What?\nAnswer: Answer.", "Question: q\nAnswer: a"]
    assert [r.code for r in Q.flags(e).orderBy("pos").collect()] == ["FAQ_ENTRY_INVALID", "FAQ_EMPTY_QUESTION", "FAQ_ID_DUPLICATE", "FAQ_EMPTY_ANSWER"]
    assert Q.flags(e.limit(0)).count() == 0


def test_context_and_messages(spark):
    assert one(spark, G.formatted(F.array().cast("array<string>"))) == "No context provided."
    assert one(spark, G.formatted(F.array(F.lit("a"), F.lit("b")))) == "[1] a\n\n[2] b"
    m = one(spark, G.messages(F.lit("why"), F.array(F.lit("a"))))
    assert [x.role for x in m] == ["system", "user"] and "why" in m[1].content and "[1] a" in m[1].content


def test_budget(spark):
    h = spark.createDataFrame([(1, i + 1, "h", "w " * n) for i, n in enumerate([100, 60, 500, 5])], "query_id int, rank int, head string, text string")
    got = G.budgeted(h, 250).orderBy("rank").collect()
    assert [(x.rank, x.truncated) for x in got] == [(1, False), (2, False), (3, True)] and sum(x.tokens for x in got) <= 250


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    h = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate("axbyc")], "query_id int, chunk_id string, rank int")
    rel = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id int, chunk_id string")
    got = {r.query_id: r for r in V.per_query(q, h, rel, 5).collect()}
    assert (got[1].precision, got[1].recall, got[1].rr) == (0.4, 1.0, 1.0) and (got[2].precision, got[2].rr) == (0.0, 0.0)
    m = V.macro(V.per_query(q, h, rel, 5), 5).first()
    assert (m.num_queries, m.precision_at_k, m.recall_at_k, m.mrr) == (2, 0.2, 0.5, 0.5)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_registered_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = db.execute(registry.SQL[name])
    cols = [c[0] for c in found.description]
    norm = lambda rows: sorted(tuple(str(round(float(x), 5)) if isinstance(x, float) else str(x) for x in r) for r in rows)
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert norm(map(tuple, df.select(*cols).collect())) == norm(found.fetchall())


def _shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    none = spark._jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bm25_shuffles_best_hits_not_all_pairs(spark):
    rows = [(i, i, f"common word{i % 50} " + "common " * (i % 3)) for i in range(3000)]
    ix = R.index(spark.createDataFrame(rows, "chunk_id long, pos long, text string"))
    asked = spark.createDataFrame([(i, f"common word{i}") for i in range(40)], "query_id long, text string")
    before = _shuffled(spark)
    hits = R.bm25(asked, ix, 5).collect()
    time.sleep(1)  # the listener follows
    assert _shuffled(spark) - before < 40 * 3000 / 4
    best = [i for i in range(0, 3000, 150)][:5]  # the shortest chunks with word0, the first of equals
    assert sorted((r.rank, r.chunk_id) for r in hits if r.query_id == 0) == list(enumerate(best, 1))
    assert len(hits) == 200
    assert len(R.bm25_scores(asked.where("query_id < 2"), ix).collect()) == 6000


def test_distractors_leave_out_each_querys_own_chunks(spark):
    rows = [(i, i, "common " + "pad " * i + ("rare" if i < 4 else "other")) for i in range(40)]
    ix = R.index(spark.createDataFrame(rows, "chunk_id long, pos long, text string"))
    asked = spark.createDataFrame([(1, "rare"), (2, "rare")], "query_id long, text string")
    own = spark.createDataFrame([(1, 0), (2, 1), (2, 2)], "query_id long, chunk_id long")
    got = {(r.query_id, r.chunk_id): r.score for r in R.remainder_scores(asked, ix, own, 10).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (2, 0), (2, 3)}
    for q, gone in ((1, {0}), (2, {1, 2})):
        whole = R.index(spark.createDataFrame([r for r in rows if r[0] not in gone], "chunk_id long, pos long, text string"))
        want = {(q, r.chunk_id): r.score for r in R.bm25_scores(asked.where(f"query_id = {q}"), whole).collect()}
        assert want.keys() == {x for x in got if x[0] == q} and all(abs(want[x] - got[x]) < 1e-9 for x in want)


def test_sections_shuffle_pages_not_lines(spark):
    filler = "\n".join(f"words {i}" for i in range(300))
    rows = [(d, p, f"x\n§ {p}\nTitle\n{filler}") for d in range(10) for p in range(1, 4)] + [(99, 1, None), (99, 2, "a\nI.\nb")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    before = _shuffled(spark)
    got = {(r.doc_id, r.section_id): (r.start_page, r.end_page, len(r.text.split("\n")), r.title) for r in E.sections(pages).collect()}
    time.sleep(1)  # the listener follows
    assert _shuffled(spark) - before < 10 * 3 * 300 / 4
    assert got[(0, "preamble")] == (1, 2, 304, "") and got[(0, "par-2")] == (2, 3, 303, "Title") and got[(0, "par-3")] == (3, 3, 302, "Title")
    assert got[(99, "part-I")] == (2, 2, 2, "b") and len(got) == 32


def test_passages_of_any_length_are_found(spark):
    texts = ["xa b c d e f g hy", "a b\tc d e f g h", "a b c d e f g", "word " * 40_000 + "one two three four five six seven eight nine", "", None, "b c d e f g\u00a0h ä ö ü i j k l m n", "ä ö ü i j k l m"]
    passages = ["a b c d e f g h", "b c", "", "two three four five six seven eight nine", "three four five six seven eight nine", "ä ö ü i j k l m", "absent", None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(2)
    got = V.holding(chunks, spark.createDataFrame(list(enumerate(passages)), "query_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((q, c) for q, p in enumerate(passages) for c, t in enumerate(texts) if p is not None and t is not None and p in t)


def test_keys_do_not_depend_on_the_place(spark, monkeypatch):
    monkeypatch.setattr(V, "KEY_BYTES", 64)
    rows = [(0, "a b c d e f g"), (1, "  a b c d e f"), (2, "x" * 100 + " a b c d e f"), (3, "a b c d e"), (4, ""), (5, "a b c d e f")]
    got = {(r.id, r.at): r.key for r in V.keys(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id").collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (2, 0), (2, 1), (5, 0)} and len({got[x] for x in [(0, 0), (1, 0), (2, 1), (5, 0)]}) == 1 and len(set(got.values())) == 3


def test_blocks_are_scored_by_groups_of_postings(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefghijkl") for _ in range(n))
    ix = R.index(spark.createDataFrame([(i, i, text(i % 7)) for i in range(120)], "chunk_id int, pos int, text string"))
    asked = spark.createDataFrame([(q, text(5)) for q in range(9)] + [(9, "absent"), (10, "")], "query_id int, text string")
    found = lambda: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in R.bm25(asked, ix, 6).collect())
    whole = found()
    monkeypatch.setattr(R, "PAIRS", 16)
    assert len(whole) > 40 and found() == whole


def test_words_are_counted_into_vectors_in_one_pass(spark):
    texts = ["a b a ä", "", None, " ".join(f"w{i % 300}" for i in range(5000))]
    rows = R.embedded(spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1))
    for r in rows.collect():
        want = None if r.text is None else [0.0] * 64
        for w in (r.text or "").split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64] += 1
        assert r.embedding == want
    assert "array_remove" not in rows._jdf.queryExecution().toString()


def test_texts_are_not_shuffled_to_meet_hits(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30000")  # bytes, less than the texts have
    try:
        assert "SortMergeJoin" not in registry._texts(spark, SF, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_filter_works_terms_out_again(spark):
    words = [f"w{(i * 7919) % 1500}" for i in range(4000)]
    rows = spark.createDataFrame([(1, 1, " ".join(words)), (2, 2, "w1 w1 W2"), (3, 3, ""), (4, 4, None)], "chunk_id long, pos long, text string")
    docs = R.counted(rows)
    ix = R.index(rows, docs=docs)
    plan = ix.df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "split(" in x]
    # a filter of one's own works them out once a text, not once a word: the lambdas hold no split
    kept = docs.where("size(terms) > 0")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "= sort_array(" not in plan and "lambdafunction(sort_array(" not in plan
    assert {r.chunk_id: (r.dl, len(r.terms), sum(r.tfs)) for r in kept.collect()} == {1: (4000, 1500, 4000), 2: (3, 2, 3)}
    df = {r.term: r.df for r in ix.df.collect()}
    assert len(df) == 1500 and df["w1"] == df["w2"] == 2 and sum(df.values()) == 1502


#: Texts that are null or stand between Unicode blanks, a null language.
ODD = [(1, "a ", "en", "s"), (2, "　b\nc ", "de", "s"), (3, None, "en", "s"), (4, "w", None, "s"), (45, "x y", "en", "t")]


def odd_documents(spark, tmp_path, names):
    """Rows of a query on ODD, and of its SQL."""
    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = registry.QUERIES[names](spark, str(tmp_path))
    return sorted(map(tuple, got.collect()), key=str), sorted(db.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.SQL[names]})").fetchall(), key=str)


def test_sections_of_odd_documents(spark, tmp_path):
    got, want = odd_documents(spark, tmp_path, "sections")
    assert len(got) == 9 * len(ODD) and got == want


def test_extracted_odd_documents(spark, tmp_path):
    got, want = odd_documents(spark, tmp_path, "extracted_documents")
    assert len(got) == 9 * len(ODD)
    # a part of a null makes the SQL's text null, where the operator leaves a line empty
    known = [i for i, r in enumerate(want) if r[5] is not None]
    assert len(known) == len(want) - 2 and [r[:5] for r in got] == [r[:5] for r in want] and all(got[i][:6] == want[i][:6] for i in known)
    assert [r[6] for r in got if r[0] not in (3, 4)] == [r[6] for r in want if r[0] not in (3, 4)]
