"""Contents of a document, headings of any depth and references between questions, on awkward rows."""

import random

from pyspark.sql import functions as F

from ravelin.operators import chunking as C
from ravelin.operators import contents as I
from ravelin.operators import extractor as X
from ravelin.operators import faq as Q


def entries(spark, *texts):
    pages = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc_id string, page int, text string")
    return [tuple(r)[1:] for r in I.parse_contents(pages, pages.select("doc_id", "page"))[0].orderBy("toc_id").collect()]


def test_contents(spark):
    got = entries(spark, "Inhaltsverzeichnis\nI.\nAllgemeines\n3\n§ 1 Ziel\n  4 \n§ 2\nZweck des Studiums\n5\n§ 3\n6", "§ 3\n6\nAnlage 2\n§ 4 Bei Anlage\n§ 5 Dauer-\nhaft\n7\nII. ENDE\nGUT\n99")
    assert got == [
        ("toc_0001", None, "part", "I", "Allgemeines", 3, "I.\nAllgemeines\n3", "I.\nAllgemeines\n3"),
        ("toc_0002", "toc_0001", "paragraph", "§ 1", "Ziel", 4, "§ 1 Ziel\n4", "§ 1 Ziel\n4"),
        ("toc_0003", "toc_0001", "paragraph", "§ 2", "Zweck des Studiums", None, "§ 2", "§ 2"),  # a title below is only looked at
        ("toc_0004", "toc_0001", "paragraph", "§ 3", None, 6, "§ 3\n6", "§ 3\n6"),  # again on the next page: one entry
        ("toc_0005", None, "annex", "Anlage 2", "§ 4 Bei Anlage", None, "Anlage 2\n§ 4 Bei Anlage", "Anlage 2\n§ 4 Bei Anlage"),  # a marker taken as a title is no entry
        ("toc_0006", "toc_0005", "paragraph", "§ 5", "Dauerhaft", None, "§ 5 Dauer-", "§ 5 Dauer-"),
        ("toc_0007", None, "part", "II", "ENDE GUT", None, "II. ENDE", "II. ENDE"),
    ]
    assert entries(spark, "§ 1\n§ 2\n§ 3\n§ 4\n8\n§ 5") == [
        ("toc_0001", None, "paragraph", "§ 1", "§ 2", None, "§ 1\n§ 2", "§ 1\n§ 2"),
        ("toc_0002", None, "paragraph", "§ 3", "§ 4", 8, "§ 3\n§ 4\n8", "§ 3\n§ 4\n8"),
        ("toc_0003", None, "paragraph", "§ 5", None, None, "§ 5", "§ 5"),
    ]
    assert [x[3:5] for x in entries(spark, "XXXI. Zu viel\nIV. § 3 hier\n§ 7 siehe Satz 2\n§ 8 unten\n§ 9 Oben.\n12\nL.\nX.\n")] == [("§ 9", "Oben."), ("X", None)]


def test_contents_flags(spark):
    pages = spark.createDataFrame([("none", 1, "§ 1 Ziel"), ("bare", 1, "nur Text"), ("null", 1, None), ("ok", 1, "I.")], "doc_id string, page int, text string")
    toc = pages.where("doc_id <> 'none'").select("doc_id", "page")
    found, flags = I.parse_contents(pages, toc)
    assert [r.doc_id for r in found.collect()] == ["ok"]
    assert sorted((r.code, r.context) for r in flags.collect()) == [("TOC_NOT_FOUND", '{"doc_id":"none"}'), ("TOC_PARSE_EMPTY", '{"doc_id":"bare"}'), ("TOC_PARSE_EMPTY", '{"doc_id":"null"}')]
    none = pages.limit(0)
    assert [x.count() for x in I.parse_contents(none, none.select("doc_id", "page"))] == [0, 0]


def test_scan_of_markers(spark):
    """Reading in stretches is reading from the first marker on."""
    rng = random.Random(4)
    rows, expected = [], []
    for doc in range(40):
        until = 0
        for n in sorted(rng.sample(range(60), 40)):
            reach = n + rng.choice([1, 1, 2, 3])
            rows.append((doc, n, reach, f"m{n}"))
            if n >= until:
                until = reach
                expected.append((doc, n))
    got = I.visited(spark.createDataFrame(rows, "doc_id int, n int, reach int, name string").repartition(3))
    assert sorted((r.doc_id, r.n) for r in got.collect()) == expected and {r.name for r in got.collect()} <= {f"m{n}" for n in range(60)}


def test_headings(spark):
    chain = [("d", f"s{i}", f"s{i - 1}" if i else None, f"{i}.", "T" if i % 2 else " ") for i in range(13)]
    rows = [*chain, ("d", "a", "b", "A", None), ("d", "b", "a", "B", ""), ("d", "lost", "nowhere", None, "Lost"), ("d", "me", "me", "M", ""), ("d", "bare", "", None, " "), ("e", "s1", "s0", "other", "document"), (None, "n", "n", "N", None)]
    got = {(r.doc_id, r.section_id): r.heading_path for r in C.headings(spark.createDataFrame(rows, "doc_id string, section_id string, parent_section_id string, label string, title string")).collect()}
    name = lambda i: f"{i}. T" if i % 2 else f"{i}."
    assert all(got["d", f"s{i}"] == [name(j) for j in range(max(0, i - 9), i + 1)] for i in range(13))
    assert got["d", "a"] == ["B", "A"] * 5 and got["d", "me"] == ["M"] * 10 and got["d", "lost"] == ["Lost"] and got["d", "bare"] == [] and got["e", "s1"] == ["other document"] and got[None, "n"] == ["N"]
    assert C.headings(spark.createDataFrame([], "doc_id string, section_id string, parent_section_id string, label string, title string")).count() == 0


def test_service_entries(spark):
    rows = [
        ("s", 0, True, "007", " q ", "a", None, "Q b", "3", "siehe § 5a - 7 Abs."), ("s", 1, True, "7", "q", "a", None, None, None, None), ("s", 2, True, "Q b", "", "a", None, None, None, None),
        ("s", 3, True, "Q b", "q", "a", "7", "nobody", "0", " "), ("s", 4, True, "q_B!", "q", "a", None, None, "x", None), ("s", 5, False, "9", "q", "a", None, None, None, None), ("s", 6, True, "  ", "q", "a", None, None, None, None),
        ("s", 7, True, "7", "", "", None, None, None, None), ("t", 0, True, "1", "q", None, None, None, None, None), ("u", 0, True, "7", "q", "a", "Q b", None, "", None),
    ]
    e = spark.createDataFrame(rows, "faq_source string, pos int, is_object boolean, id string, question string, answer string, previous_question string, next_question string, page string, section string").repartition(3)
    chunks, flags = Q.service_entries(e)
    got = [tuple(r) for r in chunks.select("chunk_id", "faq_id", "text", "token_count", "chunk_index", "paragraph_label", "page", "prev_chunk_id", "next_chunk_id", "previous_question_chunk_id", "next_question_chunk_id").orderBy("chunk_id").collect()]
    assert got == [
        ("faq_s_0007", "7", "Frage: q\nAntwort: a", 4, 0, "§ 5a - 7", 3, None, "faq_s_q_b", None, "faq_s_q_b"),
        ("faq_s_q_b", "Q b", "Frage: q\nAntwort: a", 4, 1, None, None, "faq_s_0007", None, "faq_s_0007", None),
        ("faq_u_0007", "7", "Frage: q\nAntwort: a", 4, 0, None, None, None, None, None, None),
    ]
    found = sorted((r.code, r.severity) for r in flags.collect())
    assert found == sorted([("FAQ_ID_DUPLICATE", "warning")] * 2 + [("FAQ_EMPTY_QUESTION_OR_ANSWER", "warning")] * 2 + [("QUESTION_ITEM_NOT_OBJECT", "warning"), ("FAQ_ID_MISSING", "warning"), ("CHUNK_ID_COLLISION", "error"), ("NEXT_QUESTION_REFERENCE_MISSING", "info"), ("PREVIOUS_QUESTION_REFERENCE_MISSING", "info"), ("ALL_QUESTIONS_SKIPPED", "error")] + [("FAQ_PAGE_INVALID", "info")] * 2)
    least = e.select("faq_source", "pos", F.lit("1").alias("id"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    assert Q.service_entries(least)[0].count() == 3 and [x.count() for x in Q.service_entries(least.limit(0))] == [0, 0]


def test_extract(spark):
    pages = spark.createDataFrame([("d", 1, "Title"), ("d", 2, "2\nI.\nGeneral\n§ 1\nScope\ntext"), ("d", 3, "3\nmore\n§ 2\nGoals"), ("blank", 1, None)], "doc_id string, page int, text string")
    cells = [("d", 1, 2, ["a", "", "b"]), ("d", 1, 2, [" ", None, ""]), ("d", 1, 2, ["1", "", "2"]), ("d", 2, 2, ["x"]), ("d", 3, 7, ["lost"]), ("d", 4, 1, ["first"]), ("d", 5, 3, [" "]), ("gone", 1, 1, ["no document"])]
    raw = spark.createDataFrame([(d, t, p, i, c) for i, (d, t, p, c) in enumerate(cells)], "doc_id string, table_seq int, page int, pos int, cells array<string>").repartition(2)
    got = {r.doc_id: r for r in X.extract(pages, raw).collect()}
    assert set(got) == {"d", "blank"} and got["d"].total_pages == 3 and [s.section_id for s in got["blank"].sections] == ["preamble"]
    made = [(s.section_id, s.start_page, s.end_page, s.text, [(t.table_id, t.page, t.headers, t["rows"]) for t in s.tables]) for s in got["d"].sections]
    assert made == [
        ("preamble", 1, 1, "Title", [("preamble-tbl-1", 1, ["first"], [])]),
        ("part-I", 2, 2, "I.\nGeneral", []),
        ("par-1", 2, 3, "§ 1\nScope\ntext\nmore", [("par-1-tbl-1", 2, ["a", "b"], [["1", "2"]]), ("par-1-tbl-2", 2, ["x"], [])]),
        ("par-2", 3, 3, "§ 2\nGoals", []),
    ]
    assert X.extract(pages.limit(0), raw.limit(0)).count() == 0


def test_service_extraction(spark):
    pages = spark.createDataFrame([("d", 1, "Studien- und Prüfungsordnung des Fachs"), ("d", 2, "Inhaltsverzeichnis\n§ 1 Ziel\n3"), ("d", 3, "I.\nTeil\n§ 1 Ziel\nText"), ("d", 4, "noch Text\n§ 2 Dauer")], "doc_id string, page int, text string")
    tables = spark.createDataFrame([("d", 5, 4, [["a-\nb", None]]), ("d", 2, 3, [["c"]]), ("d", 9, 2, [["on the contents"]]), ("d", 1, 3, [["", " "]])], "doc_id string, table_seq int, page int, rows array<array<string>>")
    made = X.run(pages, tables)
    assert [(r.label, r.start_page, r.end_page) for r in made.sections.orderBy("section_id").collect()] == [("I", 3, 3), ("§ 1", 3, 4), ("§ 2", 4, 4)]
    assert [(r.toc_id, r.title, r.referenced_page) for r in made.contents.collect()] == [("toc_0001", "Ziel", 3)]
    assert sorted((r.table_id, r.section_id, r["rows"]) for r in made.tables.where("section_id is not null").collect()) == [("tbl_0002", "sec_0001", [["c"]]), ("tbl_0003", "sec_0003", [["ab", ""]])]
    assert {(r.code, r.severity) for r in made.flags.collect()} == {("UNASSIGNED_TABLE", "warning"), ("EMPTY_TABLE_SKIPPED", "info"), ("MISSING_INSTITUTION", "warning"), ("MISSING_VERSION_DATE", "warning"), ("MISSING_FACULTY", "warning")}
    assert made.context.first().document_type == "Studien- und Prüfungsordnung"
