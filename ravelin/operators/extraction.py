"""Pages to sections and tables, as windows and joins partitioned by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.functions.text import tidy

# The phrases of a repeated table header, and the real columns of the wide module table.
HEADER_PHRASES = ("Name of module", "German translation", "Deutscher Modultitel")
WIDE_COLUMNS = (0, 3, 4, 7, 8, 9, 10)

# The patterns of section markers and page numbers.
ROMAN, PARAGRAPH, APPENDIX, NUMBER = r"^\s*([IVXLC]+)\.\s*$", r"^\s*§\s*(\d+[a-z]?)\s*$", r"(?i)^\s*Appendix\s+(\d+)\s*:\s*(.*)", r"^\s*\d{1,2}\s*$"


def lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, text) of pages(doc_id, page, text)."""
    return pages.select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def _marked_lines(pages: DataFrame) -> DataFrame:
    """All lines (doc_id, page, line, text, final_page, kind, label, title, start, seq); start is true where a section begins, seq counts these.

    Pages are shuffled by document once; all that follows is by document as well.
    """
    p = pages.select("doc_id", "page", F.when(F.col("page") == 1, F.coalesce("text", F.lit(""))).otherwise(F.col("text")).alias("text")).repartition("doc_id")
    contents = F.coalesce(F.lower("text").contains("table of contents"), F.lit(False))
    p = p.withColumns({"final_page": F.max("page").over(Window.partitionBy("doc_id")), "whole": (F.col("page") == 1) | contents})
    rows = p.select("doc_id", "page", "final_page", "whole", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    t, whole = F.col("text"), F.col("whole")
    usable = F.when((F.trim(t) != "") & ~t.rlike(NUMBER), F.trim(t))
    ahead = Window.partitionBy("doc_id", "page").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    form = F.when(t.rlike(ROMAN), "part").when(t.rlike(PARAGRAPH), "paragraph").when(t.rlike(APPENDIX), "appendix")
    kind = F.when(whole, F.when(F.col("line") == 0, F.when(F.col("page") == 1, "preamble").otherwise("toc"))).when(F.col("page") > 1, form)
    rows = rows.withColumns({"next": F.coalesce(F.last(usable, ignorenulls=True).over(ahead), F.lit("")), "kind": kind})
    k = F.col("kind")
    label = F.when(k == "preamble", "Preamble").when(k == "toc", "Table of Contents").when(k == "part", F.concat(F.regexp_extract(t, ROMAN, 1), F.lit("."))).when(k == "paragraph", F.concat(F.lit("§"), F.regexp_extract(t, PARAGRAPH, 1))).when(k == "appendix", F.concat(F.lit("Appendix "), F.regexp_extract(t, APPENDIX, 1)))
    own = F.trim(F.regexp_extract(t, APPENDIX, 2))
    title = F.when(whole, "").when((k == "appendix") & (own != ""), own).otherwise(F.col("next"))
    first = Window.partitionBy("doc_id", "kind", "label").orderBy("page", "line")
    order = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"label": label, "title": title}).withColumn("start", F.col("kind").isNotNull() & (F.row_number().over(first) == 1))
    return rows.withColumn("seq", F.sum(F.col("start").cast("int")).over(order).cast("int")).drop("whole", "next")


def markers(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, kind, label, title, seq): preamble, table of contents, parts, paragraphs and appendices.

    The first of each kind and label in a document counts. A title is the next line of the same page
    that is neither blank nor a page number.
    """
    return _marked_lines(pages).where("start").select("doc_id", "page", "line", "kind", "label", "title", "seq")


def section_id(kind: Column, label: Column) -> Column:
    return (
        F.when(kind.isin("preamble", "toc"), kind)
        .when(kind == "part", F.concat(F.lit("part-"), F.regexp_replace(label, r"\.+$", "")))
        .when(kind == "paragraph", F.concat(F.lit("par-"), F.trim(F.replace(label, F.lit("§"), F.lit("")))))
        .when(kind == "appendix", F.concat(F.lit("appendix-"), F.replace(label, F.lit("Appendix "), F.lit(""))))
        .otherwise(F.replace(F.lower(label), F.lit(" "), F.lit("-")))
    )


def parents(marked: DataFrame) -> DataFrame:
    """Paragraphs belong to the part before them; an appendix in between changes nothing."""
    upto = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sid = section_id(F.col("kind"), F.col("label"))
    last = F.last(F.when(F.col("kind") == "part", sid), ignorenulls=True).over(upto)
    return marked.withColumn("section_id", sid).withColumn("parent_section_id", F.when(F.col("kind") == "paragraph", last))


def sections(pages: DataFrame) -> DataFrame:
    """One row for each marker, with all lines from its own to the next marker's (exclusive)."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]), "\n")
    head = F.min(F.when(F.col("start"), F.struct("page", "line", "kind", "label", "title", "final_page")))
    made = _marked_lines(pages).where("seq > 0").groupBy("doc_id", "seq").agg(body.alias("text"), head.alias("h")).select("doc_id", "seq", "text", "h.*")
    made = parents(made).withColumns({"next_page": F.lead("page").over(order), "next_line": F.lead("line").over(order)})
    end = F.when(F.col("next_page").isNull(), F.col("final_page")).when((F.col("next_page") == F.col("page")) | (F.col("next_line") > 0), F.col("next_page")).otherwise(F.col("next_page") - 1)
    return made.select("doc_id", "seq", "section_id", "label", "title", "kind", F.col("page").alias("start_page"), end.alias("end_page"), tidy(F.coalesce("text", F.lit(""))).alias("text"), "parent_section_id")


# ---- tables ---------------------------------------------------------------------------------------


def clean_cells(cells) -> Column:
    """Null cells become empty, line feeds blanks."""
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")))


def is_header(cells) -> Column:
    return F.array_join(clean_cells(cells), " ").rlike("|".join(HEADER_PHRASES))


def is_label(cells) -> Column:
    full = F.filter(clean_cells(cells), lambda c: c != "")
    return (F.size(full) == 1) & (F.length(F.get(full, F.lit(0))) > 10) & ~F.get(full, F.lit(0)).rlike(r"^CS\s+\d+")


def wide_rows(raw: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, cells) of the wide table: headers and labels dropped, real columns kept, empty rows dropped."""
    kept = raw.where(~is_header("cells") & ~is_label("cells")).withColumn("cells", F.array(*[F.coalesce(F.get(clean_cells("cells"), F.lit(i)), F.lit("")) for i in WIDE_COLUMNS]))
    return kept.where(F.exists("cells", lambda c: c != ""))


def continued(rows: DataFrame, columns: int) -> DataFrame:
    """Rows whose second cell is empty continue the row before, cell by cell; a leading one stays."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    head = F.when((F.get("cells", F.lit(1)) != "") | (F.row_number().over(w) == 1), 1).otherwise(0)
    group = rows.withColumn("_h", head).withColumn("grp", F.sum("_h").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = group.groupBy("doc_id", "grp").agg(F.min("pos").alias("pos"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda x: x["cells"]).alias("all"))
    cell = lambda i: F.array_join(F.filter(F.transform("all", lambda r: F.get(r, F.lit(i))), lambda c: c != ""), " ")
    return parts.select("doc_id", "pos", F.array(*[cell(i) for i in range(columns)]).alias("cells"))


def generic_table(rows: DataFrame) -> DataFrame:
    """(doc_id, table_id, headers, rows) of raw rows (doc_id, table_id, pos, cells): empty rows and columns dropped, first row is the head."""
    full = rows.withColumn("cells", clean_cells("cells")).where(F.exists("cells", lambda c: c != ""))
    tables = full.groupBy("doc_id", "table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda x: x["cells"]).alias("r"))
    use = F.filter(F.sequence(F.lit(0), F.size(F.get("r", F.lit(0))) - 1), lambda i: F.exists("r", lambda x: F.coalesce(F.get(x, i), F.lit("")) != ""))
    cut = F.transform("r", lambda x: F.transform("use", lambda i: F.coalesce(F.get(x, i), F.lit(""))))
    made = tables.withColumn("use", use).withColumn("r", cut)
    return made.select("doc_id", "table_id", F.get("r", F.lit(0)).alias("headers"), F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))).alias("rows"))


def assign_tables(tables: DataFrame, sections_: DataFrame, smallest: bool = False) -> DataFrame:
    """tables(doc_id, table_seq, page) with the section that spans their page: the last one, or the smallest; numbered within it.

    Which section a page belongs to is settled once a page, for the pages that sections span as far as
    tables reach; tables then meet their page by its number.
    """
    kind = F.when(F.col("kind") == "paragraph", 0).when(F.col("kind").isin("annex", "appendix"), 1).when(F.col("kind") == "part", 2).otherwise(3)
    order = F.struct((F.col("end_page") - F.col("start_page")).alias("a"), kind.alias("b"), F.col("section_id").alias("c")) if smallest else F.struct((-F.col("seq")).alias("a"))
    reach = tables.groupBy("doc_id").agg(F.min("page").alias("_low"), F.max("page").alias("_high"))
    spans = sections_.join(reach, "doc_id").select("doc_id", "section_id", order.alias("o"), F.greatest("start_page", "_low").alias("x"), F.least("end_page", "_high").alias("y")).where("x <= y")
    pages = spans.select("doc_id", "section_id", "o", F.explode(F.sequence("x", "y")).alias("page")).groupBy("doc_id", "page").agg(F.min(F.struct("o", "section_id")).alias("m")).select("doc_id", "page", "m.section_id")
    best = tables.join(pages, ["doc_id", "page"])
    n = F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy("table_seq"))
    return best.select("doc_id", "table_seq", "page", "section_id", F.concat_ws("-", "section_id", F.lit("tbl"), n.cast("string")).alias("table_id"))


def toc_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page): pages that name the table of contents, and continuation pages right after them."""
    # The patterns of entries of a table of contents.
    marker, entry = r"(?i)^(?:§\s*\d+|[IVXLCDM]+\.\s*$|ANLAGE\s+\d+:?)", r"(?i)^(?:§\s*\d+|[IVXLCDM]+\.\s*$|ANLAGE\s+\d+:?|\d+\s*$)"
    rows = F.slice(F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), 1, 100)
    named = F.lower("text").contains("inhaltsverzeichnis")
    like = (F.size(F.filter("rows", lambda x: x.rlike(entry))) >= 12) & (F.size(F.filter("rows", lambda x: (F.length(x) >= 70) & ~x.rlike(marker))) <= 2)
    p = pages.select("doc_id", "page", named.alias("named"), rows.alias("rows")).select("doc_id", "page", "named", (F.col("named") | like).alias("ok"))
    w = Window.partitionBy("doc_id").orderBy("page")
    run = p.withColumn("grp", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w))
    upto = Window.partitionBy("doc_id", "grp", "ok").orderBy("page")
    return run.where("ok").withColumn("seen", F.max(F.col("named").cast("int")).over(upto)).where("seen = 1").select("doc_id", "page")
