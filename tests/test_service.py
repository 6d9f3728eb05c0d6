"""The service's variants: structure, context, chunking and flags, on literal inputs."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ravelin.operators import answering as A
from ravelin.operators import chunking as C
from ravelin.operators import evaluation as V
from ravelin.operators import extraction as E
from ravelin.operators import flags as Z
from ravelin.operators import generation as G
from ravelin.operators import service as S
from ravelin.operators import structure as D

PAGES = [
    ("d", 1, "Studien- und Prüfungsordnung Informatik\nMuster-Universität  Stadt\nFachbereich Mathematik und Informatik\nFassung vom 3. Mai 2019\nin der Fassung vom 12.4.2021"),
    ("d", 2, "Inhaltsverzeichnis\n§ 1 Zweck"),
    ("d", 3, "§ 9 Waise\nohne Teil\nI. Allgemeines\n§ 1\nZweck der Prü-\nfung\n3\nText zu eins, siehe\n§ 2 Abs. 3 der Ordnung.\n§ 2 Ziele\nText"),
    ("d", 4, "§ 2 Ziele\nmehr Text\nII.\nPRÜFUNGEN UND\nNOTEN\n§ 3 Form"),
    ("d", 5, "Anlage 1: Plan\n§ 3 Form\nin der Anlage\n XXXI. Nichts"),
    ("e", 1, "nur Text\nohne Marken"),
    ("f", 1, " \n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id string, page int, text string")


def codes(flags):
    return sorted((r.code, r.severity) for r in flags.collect())


def test_sections(spark, pages):
    toc = spark.createDataFrame([("d", 2)], "doc_id string, page int")
    sections, flags = D.parse_sections(pages, toc)
    got = {(r.doc_id, r.section_id): r for r in sections.collect()}
    d = [got["d", f"sec_{i:04d}"] for i in range(1, 9)]
    assert [(r.kind, r.label, r.title) for r in d] == [("paragraph", "§ 9", "Waise"), ("part", "I", "Allgemeines"), ("paragraph", "§ 1", "Zweck der Prüfung"), ("paragraph", "§ 2", "Ziele"), ("part", "II", "PRÜFUNGEN UND NOTEN"), ("paragraph", "§ 3", "Form"), ("annex", "Anlage 1", "Plan"), ("paragraph", "§ 3", "Form")]
    assert [r.parent_section_id for r in d] == [None, None, "sec_0002", "sec_0002", None, "sec_0005", None, "sec_0007"]
    assert (d[3].start_page, d[3].end_page) == (3, 4) and d[3].text == "§ 2 Ziele\nText\n§ 2 Ziele\nmehr Text"
    assert "Prüfung" in d[2].normalized_text and "§ 2 Abs. 3" in d[2].text
    assert got["e", "sec_0001"].label == "Dokument" and got["e", "sec_0001"].text == "nur Text\nohne Marken"
    assert len(got) == 9
    assert codes(flags) == [("DUPLICATE_PARAGRAPH_MARKER_SKIPPED", "info"), ("EMPTY_DOCUMENT", "error"), ("NO_MARKERS_FOUND", "warning"), ("ORPHAN_PARAGRAPH", "warning")]


def test_context(pages):
    made, flags = D.context(pages)
    got = {r.doc_id: r for r in made.collect()}
    assert (got["d"].document_type, got["d"].institution, got["d"].faculty, str(got["d"].version_date), got["d"].total_pages) == (D.DOCUMENT_TYPE, "Muster-Universität Stadt", "Fachbereich Mathematik und Informatik", "2021-04-12", 5)
    assert got["d"].title == "Studien- und Prüfungsordnung Informatik" and got["e"].title is None
    assert sum(r.code == "MISSING_TITLE" for r in flags.collect()) == 2


def test_headings(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(D.title_like(F.lit(x))) for x in ("Zweck", "zweck", "12", "§ 1", "Ein Satz.", "IV. Teil", "")] == [True, False, False, False, False, False, False]
    assert [one(D.paragraph_like(F.lit(x))) for x in ("Zweck", "regelt", "Abs. 2 gilt", "", "7 Tage")] == [True, False, False, True, True]
    lines = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(D.extended(F.lit("Prü-"), lines("fungs-", "ordnung", "Rest"))) == "Prüfungsordnung"
    assert one(D.extended(F.lit("AB"), lines("CD", "ef", "GH"))) == "AB CD" and one(D.extended(F.lit(None).cast("string"), lines("a"))) is None


def test_tables(spark):
    rows = [("d", 1, 1, [["a-\nb", None], ["x  y", "z"]]), ("d", 2, 2, [[None, " "]]), ("d", 3, 3, [["q"]])]
    made, flags = D.cleaned_tables(spark.createDataFrame(rows, "doc_id string, page int, table_seq int, rows array<array<string>>"))
    assert [(r.table_id, r.rows) for r in made.orderBy("page").collect()] == [("tbl_0001", [["ab", ""], ["x y", "z"]]), ("tbl_0002", [["q"]])]
    assert codes(flags) == [("EMPTY_TABLE_SKIPPED", "info")]


def test_packing():
    tk = C.Words()
    assert S.pieces("a b. c d. e f g h. i.", 4, tk) == (["a b. c d.", "e f g h.", "i."], [])
    assert S.pieces("a b c d e f.", 4, tk) == (["a b c d", "e f."], [("OVERSIZED_SENTENCE_SPLIT", 2)])
    size = lambda s: len(s.split())
    assert C.merged(["a b c d", "e", "f g h i j"], 2, 5, size, last_only=True) == ["a b c d", "e", "f g h i j"]
    assert C.merged(["a b c", "d"], 2, 5, size, last_only=True) == ["a b c d"]
    assert S.headed(["a b c", "d e", "f g h i j k l"], "H\n\n", 6, 2, tk) == (["H a b c", "H b c d e", "H f g h i j"], [("CHUNK_TRIMMED_FOR_HEADING", 2)])
    assert S.headed(["a"], "H I", 2, 0, tk) == (["H I a"], [("HEADING_TOO_LONG", 2)])
    assert S.table_texts([["a", " b "], ["", None], ["c"], ["d e f g h"], ["i"]], "", 4, tk) == (["a | b\nc", "d e f g", "h", "i"], [("TABLE_ROW_SPLIT", 5)])
    assert S.table_texts([], "H", 1, tk) == ([], [])


def test_service_chunks(spark):
    sections = spark.createDataFrame([("d", "s1", 1, "paragraph", "H", "One two. " * 60), ("d", "s2", 2, "part", "P", "never"), ("d", "s3", 3, "annex", "", " "), ("d", "s4", 4, "annex", None, "short text."), ("e", "p", 1, "part", "P", "x")], "doc_id string, section_id string, seq int, kind string, heading string, text string")
    tables = spark.createDataFrame([("d", "t1", 1, "s1", [["a", "b"], ["c", "d"]]), ("d", "t2", 2, None, [["x"]]), ("d", "t3", 3, "s1", [])], "doc_id string, table_id string, seq int, section_id string, rows array<array<string>>")
    chunks, flags = S.chunked(sections, tables, 50, 8, 5)
    got = chunks.orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == [f"ch_{i:06d}" for i in range(1, len(got) + 1)]
    text = [r for r in got if r.section_id == "s1" and r.chunk_type == "text"]
    assert [r.chunk_index for r in got if r.section_id == "s1"] == list(range(len(text) + 1)) and max(r.token_count for r in got) <= 50
    assert [r.prev_chunk_id for r in text] == [None, *[r.chunk_id for r in text[:-1]]] and text[-1].next_chunk_id is None
    assert text[1].text.split()[1:6] == text[0].text.split()[-5:]
    assert [r.text for r in got if r.chunk_type == "table"] == ["H a | b c | d", "x"]
    assert codes(flags) == [("NO_TEXT_SECTIONS", "warning"), ("SECTION_EMPTY_SKIPPED", "info"), ("TABLE_CHUNKS_BELOW_MIN", "info"), ("TABLE_WITHOUT_SECTION", "info"), ("TEXT_CHUNKS_BELOW_MIN", "info")]
    assert json.loads(next(r.context for r in flags.collect() if r.code == "TABLE_WITHOUT_SECTION"))["table_id"] == "t2"


def test_flags(spark):
    assert len(Z.SEVERITY) == 67
    rows = spark.createDataFrame([("A", "error"), ("B", "odd")], "code string, severity string")
    assert [tuple(r) for r in Z.propagated(rows, "sparse").orderBy("code").collect()] == [("SPARSE_A", "error"), ("SPARSE_B", "warning")]


def test_byte_pairs():
    import public_tokenizers

    tk = C.BytePairs(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = "Der Prüfungsausschuss entscheidet über § 7, 3 times."
    assert tk.decode(tk.encode(text)) == text and len(tk.encode(text)) < len(text)


class Canned(G.Client):
    """Replies by what the question says."""

    def reply(self, messages):
        user = messages[-1]["content"]
        if "boom" in user:
            raise RuntimeError("down")
        if "junk" in user:
            return "no json at all"
        if "Reference answer" in user:
            return json.dumps({"correct": "right" in user.split("Answer: ")[-1], "confidence": 0.9, "reasoning": "r"})
        low, shy = "unsure" in user, "shy" in user
        return f'Here: {json.dumps({"answer": " yes ", "should_abstain": shy, "confidence": "low" if low else "high", "reasoning": "because"})}'


def test_answers(spark):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["plain", "boom", "junk", "unsure", "shy", "nohits", "weak", "single"])], "query_id int, text string")
    rows = [(i, r, "a", f"c{r}", "some text", 0.001 if i == 6 else 0.03, r, None if i == 7 else r) for i in range(8) if i != 5 for r in (1, 2)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, source_type string, chunk_id string, text string, rrf_score double, sparse_rank int, vector_rank int")
    answers, flags = A.answered(q, hits, None, Canned)
    got = {r.query_id: r for r in answers.collect()}
    assert [got[i].reason for i in range(8)] == [None, "LLM_CALL_FAILED", "LLM_OUTPUT_INVALID", "LOW_LLM_CONFIDENCE", "LLM_ABSTAINED", "NO_RETRIEVAL_HITS", "LOW_RELEVANCE_SCORE", "INSUFFICIENT_DUAL_BACKEND_EVIDENCE"]
    assert got[0].answer == "yes" and got[1].answer == A.REFUSAL and got[0].hit_count == 2 and len(got[0].used_chunks) == 2 and 0 < got[0].used_tokens <= A.Limits().context()
    assert [c for c, _ in codes(flags)] == ["CONTEXT_EMPTY_AFTER_BUDGETING", "LLM_CALL_FAILED", "LLM_OUTPUT_INVALID", *["LLM_REASONING"] * 3]
    bad = spark.createDataFrame([(0, "SOURCE_FILE_READ_ERROR", "error"), (7, "BACKEND_UNREACHABLE", "warning")], "query_id int, code string, severity string")
    more, every = A.chat(q, lambda _: (hits, bad), ["a"], Canned, override=replace(A.NO_OVERRIDE, on_degradation=False), mode="sparse")
    got = {r.query_id: r.reason for r in more.collect()}
    assert got[0] == "RETRIEVAL_ERROR_FLAG" and got[7] is None and got[5] == "NO_RETRIEVAL_HITS" and every.where("stage = 'retrieval'").count() == 2
    assert A.chat(q, lambda _: (hits, bad), ["b"], Canned)[0].where("abstained").count() == 8
    with pytest.raises(ValueError, match="too little"):
        A.Limits(budget=800).context()


def test_json_client():
    asked = []
    client = A.JsonClient(lambda m, form: (asked.append(form), (400, "") if isinstance(form, dict) else (200, "{}"))[1])
    assert client.reply([]) == "{}" and asked == [A.JsonClient.SCHEMA, "json"]
    with pytest.raises(RuntimeError, match="503"):
        A.JsonClient(lambda m, form: (503, "")).reply([])


class Echoing(G.Client):
    def reply(self, messages):
        user = messages[-1]["content"]
        if "broken" in user:
            raise RuntimeError("down")
        return "right" if "noise0" not in user else "wrong"


def test_generation_run(spark):
    q = spark.createDataFrame([(1, "why", "ref", False), (2, "broken", "ref", False), (3, "what", "ref", True), (4, " ", "ref", False), (5, "lost", "ref", False)], "query_id int, text string, reference_answer string, expected_abstention boolean")
    rel = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r"), (4, "r"), (5, "gone")], "query_id int, chunk_id string")
    noise = spark.createDataFrame([(i, f"n{k}", k + 1) for i in (1, 2) for k in range(3)], "query_id int, chunk_id string, rank int")
    chunks = spark.createDataFrame([("r", "relevant"), *[(f"n{k}", f"noise{k}") for k in range(3)]], "chunk_id string, text string")
    assert {r.query_id: r.why for r in V.skipped(q, rel, chunks).collect()} == {3: "ABSTENTION_EXPECTED", 4: "EMPTY_QUESTION", 5: "NO_RELEVANT_CHUNK"}
    got = V.generation_run(q, rel, noise, chunks, [0, 2], Echoing, Canned)
    rows = {(r.query_id, r.level): r for r in got.collect()}
    assert {k: r.correct for k, r in rows.items()} == {(1, 0): True, (1, 2): False, (2, 0): False, (2, 2): False} and rows[2, 0].error == "down"
    report = V.generation_report(got, "m", "j", [2, 0, 2]).first()
    assert report.accuracy == 0.25 and report.levels == [0, 2] and [(x.level, x.accuracy) for x in report.by_level] == [(0, 0.5), (2, 0.0)]
    hits = spark.createDataFrame([(1, "r", 1), (3, "r", 1)], "query_id int, chunk_id string, rank int")
    r = V.retrieval_report(q, hits, rel, 5, "sparse", 4).first()
    assert (r.retriever, r.corpus_size, r.num_queries, r.recall_at_k) == ("sparse", 4, 4, 0.25)


def test_contents_of_numbers_alone(spark):
    """Lines are trimmed of blanks only, whatever their place."""
    pages = [("d", 1, "Titel"), ("d", 2, "Inhaltsverzeichnis"), ("d", 3, "\n".join(f" {i} " for i in range(14))), ("d", 4, "Prosa")]
    got = E.toc_pages(spark.createDataFrame(pages, "doc_id string, page int, text string")).collect()
    assert sorted(r.page for r in got) == [2, 3]
