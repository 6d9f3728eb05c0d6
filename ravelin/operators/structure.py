"""The service's document structure: sections by annexes, numbered parts and paragraphs, and a document's context.

Lines are rows, so a document is one window: titles come from the lines up to the next marker, parents
are the last part or annex before. Only what depends on the marker that was kept before (repeated
paragraph markers) is folded over a document's few markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.functions import text as T
from ravelin.operators import flags as Z

# The patterns of markers, and words that speak for a mere reference to a paragraph.
ROMAN_ONLY, ROMAN_INLINE = r"^\s*([IVXLCDM]{1,8})\.\s*$", r"^\s*([IVXLCDM]{1,8})\.\s+(.+?)\s*$"
ANNEX, PARAGRAPH, NUMBER = r"(?i)^\s*Anlage\s+(\d+)\s*:?\s*(.*)\s*$", r"^\s*§+\s*(\d+[a-zA-Z]?)\s*(.*)$", r"^\s*\d+\s*$"
REFERENCE_HINTS = ("abs.", "satz", "nr.", "gemäß", "anlage")
# What a document's context is read from.
DOCUMENT_TYPE, TYPE_PATTERN = "Studien- und Prüfungsordnung", r"(?i)Studien-\s*und\s*Prüfungsordnung"
INSTITUTION, FACULTY_NUMBER, FACULTY_NAME = r"(\p{Lu}\p{L}*-Universität\s+\p{Lu}\p{L}+)", r"(?i)\bFB\s*(\d+)\b", r"Fachbereichs?\s+(\p{Lu}\p{L}+(?:\s+und\s+\p{Lu}\p{L}+)?)"
VERSION, NAMED_DATE, DOTTED_DATE = r"(?i)(?:in\s+der\s+)?Fassung\s+vom\s+([^\n,;]+)", r"(\d{1,2}\.\s*[A-Za-zÄÖÜäöüß]+\s*\d{4})", r"(\d{1,2}\.\d{1,2}\.\d{2,4})"
MAX_TITLE, MAX_UPPER, MAX_ROMAN, NEAR_PAGES, FIRST_PAGES = 140, 80, 30, 2, 4


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_upper(c: Column) -> Column:
    """Whether there are letters and all are capitals."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def structural(line: Column) -> Column:
    return line.rlike(PARAGRAPH) | line.rlike(ANNEX) | line.rlike(ROMAN_ONLY) | line.rlike(ROMAN_INLINE)


def title_like(line: Column) -> Column:
    """A line that can be a heading's title: no marker or number, short, no full stop, a capital first."""
    first = F.substring(line, 1, 1)
    return (line != "") & ~line.rlike(NUMBER) & ~structural(line) & (F.length(line) <= MAX_TITLE) & ~line.endswith(".") & is_upper(first)


def paragraph_like(title: Column) -> Column:
    """Whether what follows a paragraph sign and number is a heading, not the rest of a sentence."""
    first = F.substring(title, 1, 1)
    hint = F.lower(title).rlike("|".join(h.replace(".", r"\.") for h in REFERENCE_HINTS))
    return F.coalesce(title, F.lit("")).isin("") | (~((F.lower(first) == first) & (F.upper(first) != first)) & ~hint)


def extended(title: Column, after: Column) -> Column:
    """A title with the lines after it, as long as it ends in a hyphen or both are in capitals."""

    def step(a, line):
        t = a["t"]
        hyphen = t.endswith("-")
        grows = ~a["done"] & (hyphen | (is_upper(t) & is_upper(line) & (F.length(line) <= MAX_UPPER)))
        return F.struct(F.when(~grows, t).when(hyphen, F.concat(F.substring(t, F.lit(1), F.length(t) - 1), line)).otherwise(F.concat(t, F.lit(" "), line)).alias("t"), (~grows).alias("done"))

    return F.when(F.coalesce(title, F.lit("")) != "", F.aggregate(after, F.struct(title.alias("t"), F.lit(False).alias("done")), step)["t"])


def records(pages: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """(doc_id, n, page, text): the lines of pages(doc_id, page, text) that are not empty, white space collapsed, numbered."""
    own = pages if toc is None else pages.join(toc.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    rows = own.select("doc_id", "page", F.posexplode(F.split("text", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]", -1)).alias("line", "raw")).withColumn("text", clean(F.col("raw"))).where("text <> ''")
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line")).alias("n"), "page", "text")


def marked(rows: DataFrame) -> DataFrame:
    """(doc_id, n, page, text, kind, label, title) of the lines that are markers."""
    t = F.col("text")
    w = Window.partitionBy("doc_id").orderBy("n")
    block = structural(t) | t.rlike(NUMBER)
    held = rows.withColumn("part", F.sum(F.when(block, 1).otherwise(0)).over(w)).withColumn("next", F.lead("text").over(w))
    after = F.collect_list("text").over(Window.partitionBy("doc_id", "part").orderBy("n").rowsBetween(1, Window.unboundedFollowing))
    numeral = F.coalesce(F.nullif(F.regexp_extract(t, ROMAN_ONLY, 1), F.lit("")), F.nullif(F.regexp_extract(t, ROMAN_INLINE, 1), F.lit("")))
    inline = F.nullif(clean(F.regexp_extract(t, ROMAN_INLINE, 2)), F.lit(""))
    roman = numeral.isNotNull() & T.roman(numeral).between(1, MAX_ROMAN) & ~F.coalesce(inline.startswith("§"), F.lit(False))
    kind = F.when(t.rlike(ANNEX), "annex").when(roman, "part").when(t.rlike(PARAGRAPH), "paragraph")
    label = F.when(F.col("kind") == "annex", F.concat(F.lit("Anlage "), F.regexp_extract(t, ANNEX, 1))).when(F.col("kind") == "part", numeral).otherwise(F.concat(F.lit("§ "), F.regexp_extract(t, PARAGRAPH, 1)))
    own = F.when(F.col("kind") == "annex", F.nullif(clean(F.regexp_extract(t, ANNEX, 2)), F.lit(""))).when(F.col("kind") == "part", inline).otherwise(F.nullif(clean(F.regexp_extract(t, PARAGRAPH, 2)), F.lit("")))
    made = held.withColumns({"kind": kind, "after": F.when(structural(t), after)}).where("kind is not null").withColumns({"label": label, "own": own})
    below = F.col("own").isNull() & title_like(F.col("next"))
    title = F.when(F.col("own").isNotNull(), extended(F.col("own"), F.col("after"))).when(below, extended(F.col("next"), F.slice("after", 2, F.greatest(F.size("after") - 1, F.lit(0)))))
    made = made.withColumn("title", title)
    return made.where((F.col("kind") != "paragraph") | paragraph_like(F.col("title"))).select("doc_id", "n", "page", "text", "kind", "label", "title")


def parents(markers: DataFrame) -> DataFrame:
    """markers with parent, the place n of the annex or part before each paragraph: an annex ends the part, a part the annex."""
    upto = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return markers.withColumn("parent", F.when(F.col("kind") == "paragraph", F.last(F.when(F.col("kind") != "paragraph", F.col("n")), ignorenulls=True).over(upto)))


def kept_markers(markers: DataFrame) -> DataFrame:
    """markers with again: a paragraph of the label and parent of the marker kept before it, on its page or the NEAR_PAGES after."""
    each = F.struct("n", "page", "kind", "label", "parent", "text", "title")
    lists = markers.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("m"))  # a document's markers

    def step(a, x):
        last = a["last"]
        again = F.coalesce((x["kind"] == "paragraph") & (last["kind"] == "paragraph") & (last["label"] == x["label"]) & last["parent"].eqNullSafe(x["parent"]) & (x["page"] - last["page"] <= NEAR_PAGES), F.lit(False))
        return F.struct(F.when(again, last).otherwise(x).alias("last"), F.array_append(a["out"], again).alias("out"))

    first = F.get(F.filter("m", lambda x: F.lit(False)), F.lit(0))
    state = F.struct(first.alias("last"), F.array().cast("array<boolean>").alias("out"))
    folded = lists.withColumn("again", F.aggregate("m", state, step)["out"])
    return folded.select("doc_id", F.inline(F.arrays_zip("m", "again"))).select("doc_id", "m.*", "again")


def parse_sections(pages: DataFrame, toc: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, flags) of pages(doc_id, page, text) without the pages toc(doc_id, page).

    A section reaches to the next marker. A document without markers is one section; one without text has none.
    """
    rows = records(pages, toc)
    found = kept_markers(parents(marked(rows)))
    kept = found.where(~F.col("again"))
    order = Window.partitionBy("doc_id").orderBy("n")
    numbered = kept.withColumns({"section_id": F.concat(F.lit("sec_"), F.lpad(F.row_number().over(order).cast("string"), 4, "0")), "until": F.lead("n").over(order)})
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    owned = rows.join(numbered.select("doc_id", "n", F.col("n").alias("of")), ["doc_id", "n"], "left").withColumn("of", F.last("of", ignorenulls=True).over(upto))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    body = owned.groupBy("doc_id", "of").agg(F.array_join(lines, "\n").alias("text"), F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    up = numbered.select("doc_id", F.col("n").alias("parent"), F.col("section_id").alias("parent_section_id"))
    named = numbered.select("doc_id", "n", "section_id", "kind", "label", "title", "parent").join(up, ["doc_id", "parent"], "left").join(body.withColumnRenamed("of", "n"), ["doc_id", "n"])
    columns = ["doc_id", "section_id", "parent_section_id", "kind", "label", "title", "start_page", "end_page", "text"]
    bare = body.where("of is null").join(numbered.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = bare.select("doc_id", F.lit("sec_0001").alias("section_id"), F.lit(None).cast("string").alias("parent_section_id"), F.lit("part").alias("kind"), F.lit("Dokument").alias("label"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("start_page"), "end_page", "text")
    sections = named.select(*columns).unionByName(whole).withColumn("normalized_text", T.joined_lines(F.col("text")))
    empty = pages.select("doc_id").distinct().join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
    flags = Z.together(
        Z.flagged(empty, "pdf_extractor", "EMPTY_DOCUMENT", "doc_id"),
        Z.flagged(bare, "pdf_extractor", "NO_MARKERS_FOUND", "doc_id"),
        Z.flagged(found.where("kind = 'paragraph' and parent is null").withColumnRenamed("text", "line"), "pdf_extractor", "ORPHAN_PARAGRAPH", "doc_id", "page", "line"),
        Z.flagged(found.where("again"), "pdf_extractor", "DUPLICATE_PARAGRAPH_MARKER_SKIPPED", "doc_id", "page", "label"),
    )
    return sections, flags


def context(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, document_type, title, institution, version_date, faculty, total_pages) of each document, and flags for what is missing."""
    first = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["page"] <= FIRST_PAGES), lambda x: x["text"]), "\n")
    d = pages.groupBy("doc_id").agg(first.alias("t"), F.max(F.when(F.col("page") == 1, F.col("text"))).alias("one"), F.max("page").alias("total_pages"))
    t = F.col("t")
    lines = F.filter(F.transform(F.split(F.coalesce("one", F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    title = F.coalesce(F.get(F.filter(lines, lambda x: x.contains("Studien-") & x.contains("Prüfungsordnung")), F.lit(0)), F.get(F.filter(lines, lambda x: F.length(x) > 20), F.lit(0)))
    dates = lambda p: F.filter(F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), T.german_date), lambda x: x.isNotNull())
    version = F.coalesce(F.array_max(dates(VERSION)), F.get(dates(NAMED_DATE), F.lit(0)), F.get(dates(DOTTED_DATE), F.lit(0)))
    first_of = lambda p: F.nullif(clean(F.regexp_extract(t, p, 1)), F.lit(""))
    faculty = F.coalesce(F.concat(F.lit("FB"), first_of(FACULTY_NUMBER)), F.concat(F.lit("Fachbereich "), first_of(FACULTY_NAME)))
    made = d.select("doc_id", F.when(t.rlike(TYPE_PATTERN), DOCUMENT_TYPE).alias("document_type"), title.alias("title"), first_of(INSTITUTION).alias("institution"), version.alias("version_date"), faculty.alias("faculty"), "total_pages")
    missing = [Z.flagged(made.where(F.col(c).isNull()), "pdf_extractor", f"MISSING_{c.upper()}", "doc_id") for c in ("document_type", "title", "institution", "version_date", "faculty")]
    return made, Z.together(*missing)


def cleaned_tables(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, flags) of tables(doc_id, page, rows): cells on one line, numbered tbl_0001 on; tables without any text are left out, with a flag."""
    cell = lambda c: F.replace(T.joined_lines(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    t = tables.withColumn("rows", F.transform("rows", lambda r: F.transform(r, cell)))
    full = F.exists("rows", lambda r: F.exists(r, lambda c: c != ""))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "table_seq"))
    return t.where(full).withColumn("table_id", F.concat(F.lit("tbl_"), F.lpad(n.cast("string"), 4, "0"))), Z.flagged(t.where(~full), "pdf_extractor", "EMPTY_TABLE_SKIPPED", "doc_id", "page")
