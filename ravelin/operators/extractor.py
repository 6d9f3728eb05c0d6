"""Whole documents from their pages and raw tables: the steps of extraction and structure put together, on one stored copy of the pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import contents as I
from ravelin.operators import extraction as E
from ravelin.operators import flags as Z
from ravelin.operators import structure as D
from ravelin.sources.store import written


def extract(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, total_pages, sections) of pages(doc_id, page, text) and raw table rows (doc_id, table_seq, page, pos, cells).

    sections is an array in order of (section_id, label, title, kind, parent_section_id, start_page,
    end_page, text, tables), tables one of (table_id, page, headers, rows). Page numbers on top of pages go.
    A table belongs to the last section that spans its page; one that no section spans is left out.
    """
    own = written(pages.select("doc_id", "page", T.without_page_number(F.coalesce("text", F.lit("")), F.col("page")).alias("text")), "pages")
    sections = written(E.sections(own), "sections")
    made = E.generic_table(tables.select("doc_id", F.col("table_seq").alias("table_id"), "pos", "cells")).withColumnRenamed("table_id", "table_seq")
    places = tables.select("doc_id", "table_seq", "page").distinct()
    put = E.assign_tables(places.join(made.select("doc_id", "table_seq"), ["doc_id", "table_seq"], "left_semi"), sections)
    one = F.struct("table_seq", F.struct("table_id", "page", "headers", "rows").alias("t"))
    of = put.join(made, ["doc_id", "table_seq"]).groupBy("doc_id", "section_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]).alias("tables"))  # a section's tables
    none = F.array().cast(of.schema["tables"].dataType)
    of = of.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section_id", "tables"))).alias("of"))  # a document's tables
    fields = F.struct("section_id", "label", "title", "kind", "parent_section_id", "start_page", "end_page", "text")
    listed = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", fields.alias("s")))).alias("listed"))  # a document's sections, whose texts are shuffled by document alone
    names = [f.name for f in sections.select(fields.alias("s")).schema["s"].dataType.fields]
    whole = lambda x: F.struct(*[x["s"][c].alias(c) for c in names], F.coalesce(F.element_at("of", x["s"]["section_id"]), none).alias("tables"))
    listed = listed.join(of, "doc_id", "left").select("doc_id", F.transform("listed", whole).alias("sections"))
    return own.groupBy("doc_id").agg(F.max("page").alias("total_pages")).join(listed, "doc_id", "left").select("doc_id", "total_pages", F.coalesce("sections", F.array().cast(listed.schema["sections"].dataType)).alias("sections"))


@dataclass
class Extraction:
    """What the service's extraction gives, a table each."""

    sections: DataFrame
    contents: DataFrame
    tables: DataFrame
    context: DataFrame
    flags: DataFrame


def run(pages: DataFrame, tables: DataFrame) -> Extraction:
    """The service's extraction of pages(doc_id, page, text) and tables(doc_id, table_seq, page, rows).

    Pages of contents are found first and take no part in the sections. A table goes to the smallest section that spans
    its page; without one its section_id is null, with a flag.
    """
    own = written(pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text")), "pages")
    toc = written(E.toc_pages(own), "toc")
    entries, flags_toc = I.parse_contents(own, toc)
    sections, flags_sections = D.parse_sections(own, toc)
    sections = written(sections, "sections")
    clean, flags_tables = D.cleaned_tables(tables)
    clean = written(clean, "tables")
    spans = sections.select("doc_id", F.expr("int(substring(section_id, 5))").alias("seq"), "section_id", "kind", "start_page", "end_page")
    put = E.assign_tables(clean.select("doc_id", "table_seq", "page"), spans, smallest=True).select("doc_id", "table_seq", "section_id")
    placed = clean.join(put, ["doc_id", "table_seq"], "left")
    context, flags_context = D.context(own)
    lost = Z.flagged(placed.where("section_id is null"), "pdf_extractor", "UNASSIGNED_TABLE", "doc_id", "page", "table_id")
    return Extraction(sections, entries, placed, context, Z.together(flags_toc, flags_sections, flags_tables, flags_context, lost))
