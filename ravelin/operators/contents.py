"""The table of contents of a document: its entries with their titles, parents and pages.

An entry may take the line after its own for its title and the one after that for its page, so whether a line
is read as an entry depends on the entries before it. Only marker lines can be entries, and one reaches two lines ahead at most:
a marker that no marker before it can reach is read in any case. Those cut a document into short stretches,
and only inside these is the scan sequential, a fold over what each marker would take. All else, parents,
repeats and numbers, are windows over the entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.functions import text as T
from ravelin.operators import flags as Z
from ravelin.operators.structure import ANNEX, MAX_ROMAN, NUMBER, PARAGRAPH, ROMAN_INLINE, ROMAN_ONLY, clean, extended, paragraph_like, records, structural, title_like

# Fixed value: a line with this word names the contents and is no entry.
CONTENTS = "inhaltsverzeichnis"


def candidates(rows: DataFrame) -> DataFrame:
    """(doc_id, n, kind, label, title, page, text, entry, reach) of the marker lines of rows(doc_id, n, text): what each would be, and the line after all that it takes.

    entry is false for a mere reference to a paragraph, which takes nothing.
    """
    t = F.col("text")
    w = Window.partitionBy("doc_id").orderBy("n")
    block = structural(t) | t.rlike(NUMBER)
    held = rows.select("doc_id", "n", "text", block.alias("block"), F.lead("text", 1).over(w).alias("one"), F.lead("text", 2).over(w).alias("two")).withColumn("part", F.sum(F.col("block").cast("int")).over(w))
    # the lines of a block, from its marker or number to the next one, once; a title may go on in them
    lines = held.groupBy("doc_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("lines"))
    lines = lines.withColumn("then", F.lead("lines").over(Window.partitionBy("doc_id").orderBy("part")))

    numeral = F.coalesce(F.nullif(F.regexp_extract(t, ROMAN_ONLY, 1), F.lit("")), F.nullif(F.regexp_extract(t, ROMAN_INLINE, 1), F.lit("")))
    inline = F.nullif(clean(F.regexp_extract(t, ROMAN_INLINE, 2)), F.lit(""))
    roman = numeral.isNotNull() & T.roman(numeral).between(1, MAX_ROMAN) & ~F.coalesce(inline.startswith("§"), F.lit(False))
    kind = F.when(F.lower(t).contains(CONTENTS), None).when(t.rlike(ANNEX), "annex").when(t.rlike(PARAGRAPH), "paragraph").when(roman, "part")
    heads = held.withColumn("kind", kind).where("kind is not null").join(lines, ["doc_id", "part"])
    rest_of = lambda c: F.nullif(clean(F.regexp_extract(t, c, 2)), F.lit(""))
    label = F.when(F.col("kind") == "annex", F.concat(F.lit("Anlage "), F.regexp_extract(t, ANNEX, 1))).when(F.col("kind") == "paragraph", F.concat(F.lit("§ "), F.regexp_extract(t, PARAGRAPH, 1))).otherwise(numeral)
    own = F.when(F.col("kind") == "annex", rest_of(ANNEX)).when(F.col("kind") == "paragraph", rest_of(PARAGRAPH)).otherwise(inline)
    heads = heads.select("*", label.alias("label"), own.alias("own"))

    part, one = F.col("kind") == "part", F.col("one")
    from_place = lambda c, i: F.when(F.size(c) >= i, F.slice(c, F.lit(i), F.size(c))).otherwise(F.array().cast("array<string>"))
    after_own = from_place(F.col("lines"), 2)
    after_one = F.when(structural(one), from_place(F.coalesce("then", F.array().cast("array<string>")), 2)).otherwise(from_place(F.col("lines"), 3))
    # a part takes any line that is no number; the others look at one that is like a title, but leave it where it is
    taken_by_part = part & F.col("own").isNull() & one.isNotNull() & ~one.rlike(NUMBER)
    seen = F.when(F.col("own").isNotNull(), extended(F.col("own"), after_own)).when(taken_by_part | title_like(one), extended(one, after_one))
    heads = heads.withColumn("seen", seen)
    entry = (F.col("kind") != "paragraph") | paragraph_like(F.col("seen"))
    takes = entry & (taken_by_part | (~part & F.col("seen").isNull() & one.isNotNull() & ~one.rlike(NUMBER)))
    heads = heads.select("*", entry.alias("entry"), F.coalesce(takes, F.lit(False)).alias("takes"))
    number = F.when(F.col("takes"), F.col("two")).otherwise(one)
    paged = F.col("entry") & F.coalesce(number.rlike(NUMBER), F.lit(False))
    text = F.concat_ws("\n", t, F.when(F.col("takes"), one), F.when(paged, number))
    reach = F.col("n") + 1 + F.col("takes").cast("int") + paged.cast("int")
    return heads.select("doc_id", "n", "kind", "label", F.coalesce("seen", F.when(F.col("takes"), one)).alias("title"), F.when(paged, F.expr("try_cast(trim(" + "CASE WHEN takes THEN two ELSE one END) AS bigint)")).alias("page"), text.alias("text"), "entry", reach.alias("reach"))


def visited(heads: DataFrame) -> DataFrame:
    """Those of heads(doc_id, n, reach, ...) that no marker read before them has taken."""
    order = Window.partitionBy("doc_id").orderBy("n")
    before = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = heads.withColumn("free", F.coalesce(before <= F.col("n"), F.lit(True))).withColumn("stretch", F.sum(F.col("free").cast("int")).over(order))
    names = [c for c in heads.columns if c != "doc_id"]
    lists = cut.groupBy("doc_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("n", *[c for c in names if c != "n"]))).alias("m"))  # markers within reach of each other

    def step(a, x):
        on = x["n"] >= a["until"]
        return F.struct(F.when(on, x["reach"]).otherwise(a["until"]).alias("until"), F.when(on, F.array_append(a["out"], x["n"])).otherwise(a["out"]).alias("out"))

    kind = heads.schema["n"].dataType.simpleString()
    state = F.struct(F.lit(0).cast(heads.schema["reach"].dataType).alias("until"), F.array().cast(f"array<{kind}>").alias("out"))
    on = F.aggregate("m", state, step)["out"]
    alone = F.size("m") == 1
    kept = F.when(alone, F.col("m")).otherwise(F.transform(F.filter(F.arrays_zip(F.col("m").alias("x"), F.transform("m", lambda x: F.array_contains(on, x["n"])).alias("on")), lambda y: y["on"]), lambda y: y["x"]))
    return lists.select("doc_id", F.inline(kept))


def parse_contents(pages: DataFrame, toc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, flags) of pages(doc_id, page, text), whose tables of contents stand on the pages toc(doc_id, page).

    entries: doc_id, toc_id, parent_toc_id, kind, label, title, referenced_page, original_text, normalized_text.
    """
    own = pages.join(toc.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    found = visited(candidates(records(own))).where("entry")
    order = Window.partitionBy("doc_id").orderBy("n")
    up = F.last(F.when(F.col("kind") != "paragraph", F.col("n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("up", F.when(F.col("kind") == "paragraph", up))
    # an entry like the one before it is skipped, so it is like the last one kept
    again = (F.col("kind") == "paragraph") & (F.lag("kind").over(order) == "paragraph") & (F.lag("label").over(order) == F.col("label")) & F.lag("up").over(order).eqNullSafe(F.col("up"))
    kept = found.withColumn("again", F.coalesce(again, F.lit(False))).where(~F.col("again"))
    numbered = kept.withColumn("toc_id", F.concat(F.lit("toc_"), F.format_string("%04d", F.row_number().over(order))))
    parent = F.last(F.when(F.col("kind") != "paragraph", F.col("toc_id")), ignorenulls=True).over(order)
    entries = numbered.select("doc_id", "toc_id", F.when(F.col("kind") == "paragraph", parent).alias("parent_toc_id"), "kind", "label", "title", F.col("page").alias("referenced_page"), F.col("text").alias("original_text"), T.joined_lines(F.col("text")).alias("normalized_text"))
    documents = pages.select("doc_id").distinct()
    having = toc.select("doc_id").distinct()
    flags = Z.together(
        Z.flagged(documents.join(having, "doc_id", "left_anti"), "pdf_extractor", "TOC_NOT_FOUND", "doc_id"),
        Z.flagged(documents.join(having, "doc_id", "left_semi").join(found.select("doc_id").distinct(), "doc_id", "left_anti"), "pdf_extractor", "TOC_PARSE_EMPTY", "doc_id"),
    )
    return entries, flags
