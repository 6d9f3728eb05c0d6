"""Question-and-answer collections to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.functions.text import slug, tokens
from ravelin.operators import flags as Z

OVERSIZE = 512
SEVERITY = {"FAQ_ENTRY_INVALID": "warning", "FAQ_ID_DUPLICATE": "warning", "FAQ_EMPTY_QUESTION": "warning", "FAQ_EMPTY_ANSWER": "warning"}


def _clean(c):
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))


def validated(entries: DataFrame) -> DataFrame:
    """entries(faq_source, pos, id, question, answer) trimmed, with reject_code: an id counts as taken only by an accepted entry before."""
    e = entries.withColumns({c: _clean(c) for c in ("id", "question", "answer")})
    good = (F.col("id") != "") & (F.col("question") != "") & (F.col("answer") != "")
    first = F.min(F.when(good, F.col("pos"))).over(Window.partitionBy("faq_source", "id"))
    code = F.when(F.col("id") == "", "FAQ_ENTRY_INVALID").when(first < F.col("pos"), "FAQ_ID_DUPLICATE").when(F.col("question") == "", "FAQ_EMPTY_QUESTION").when(F.col("answer") == "", "FAQ_EMPTY_ANSWER")
    return e.withColumn("reject_code", code)


def chunks(entries: DataFrame, question: str = "Question", answer: str = "Answer") -> DataFrame:
    ok = validated(entries).where("reject_code is null")
    text = F.concat(F.lit(f"{question}: "), "question", F.lit(f"\n{answer}: "), "answer")
    index = F.row_number().over(Window.partitionBy("faq_source").orderBy("pos")) - 1
    return ok.select("faq_source", "pos", "id", F.concat_ws("-", "faq_source", "id").alias("chunk_id"), text.alias("text"), F.size(F.split(F.trim(text), r"\s+")).alias("token_count"), index.alias("chunk_index"))


def flags(entries: DataFrame, limit: int = OVERSIZE) -> DataFrame:
    """(faq_source, pos, code, severity): rejected entries, oversized ones, and collections of which nothing is left."""
    rejected = validated(entries).where("reject_code is not null").select("faq_source", "pos", F.col("reject_code").alias("code"), F.lit("warning").alias("severity"))
    large = chunks(entries).where(F.col("token_count") > limit).select("faq_source", "pos", F.lit("FAQ_OVERSIZED_ENTRY").alias("code"), F.lit("info").alias("severity"))
    none = validated(entries).groupBy("faq_source").agg(F.count_if(F.col("reject_code").isNull()).alias("n")).where("n = 0").select("faq_source", F.lit(None).cast("long").alias("pos"), F.lit("FAQ_ALL_SKIPPED").alias("code"), F.lit("error").alias("severity"))
    return rejected.withColumn("pos", F.col("pos").cast("long")).unionByName(large.withColumn("pos", F.col("pos").cast("long"))).unionByName(none)


def service_id(source, faq_id):
    """faq_<source>_0001 for numbers, else a slug."""
    number = faq_id.rlike("^[0-9]+$")
    plain = F.regexp_replace(faq_id, "^0+(?=[0-9])", "")
    padded = F.when(F.length(plain) < 4, F.lpad(plain, 4, "0")).otherwise(plain)
    name = F.when(number, padded).when(slug(faq_id) == "", "unknown").otherwise(slug(faq_id))
    return F.concat(F.lit("faq_"), source, F.lit("_"), name)


def neighbours(entries: DataFrame) -> DataFrame:
    """Accepted entries with the service's chunk ids and those before and after."""
    w = Window.partitionBy("faq_source").orderBy("pos")
    made = validated(entries).where("reject_code is null").withColumn("chunk_id", service_id(F.col("faq_source"), F.col("id")))
    return made.select("faq_source", "pos", "id", "chunk_id", F.lag("chunk_id").over(w).alias("prev_chunk_id"), F.lead("chunk_id").over(w).alias("next_chunk_id"))


# How an entry's text reads in the service, and the pattern of a paragraph's label.
SERVICE_TEXT, PARAGRAPH_LABEL = ("Frage", "Antwort"), r"§\s*\d+[a-zA-Z]?(?:\s*-\s*\d+[a-zA-Z]?)?"


def normal_id(c):
    """An id trimmed, numbers without leading zeros; null if nothing is left."""
    text = F.trim(c.cast("string"))
    return F.nullif(F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", "")).otherwise(text), F.lit(""))


def service_entries(entries: DataFrame, tokenize=tokens) -> tuple[DataFrame, DataFrame]:
    """(chunks, flags) of entries(faq_source, pos, id, question, answer[, previous_question, next_question, page, section, is_object]).

    An entry is accepted if it is an object with id, question and answer and no accepted entry before it in its source has
    its id or its chunk id. Different ids may give one chunk id (a collision), equal ids always do, so the first whole
    entry of each chunk id is the accepted one. The questions that entries name as previous and next are
    resolved together, by one table of links joined once with the accepted ids. Missing columns are null.
    """
    kinds = {"previous_question": "string", "next_question": "string", "page": "string", "section": "string", "is_object": "boolean"}
    e = entries.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in entries.columns})
    e = e.select("faq_source", "pos", F.coalesce("is_object", F.lit(True)).alias("is_object"), normal_id(F.col("id")).alias("id"), *[_clean(c).alias(c) for c in ("question", "answer")], *[normal_id(F.col(c)).alias(c) for c in ("previous_question", "next_question")], F.nullif(F.trim(F.col("page").cast("string")), F.lit("")).alias("raw_page"), F.nullif(F.trim("section"), F.lit("")).alias("section"))
    e = e.withColumn("chunk_id", F.when(F.col("is_object"), service_id(F.col("faq_source"), F.col("id"))))
    whole = F.col("is_object") & F.col("id").isNotNull() & (F.col("question") != "") & (F.col("answer") != "")
    first = F.min(F.when(whole, F.struct("pos", "id"))).over(Window.partitionBy("faq_source", "chunk_id"))
    e = e.withColumn("first", first)
    later = F.col("pos") > F.col("first.pos")
    code = (
        F.when(~F.col("is_object"), "QUESTION_ITEM_NOT_OBJECT")
        .when(F.col("id").isNull(), "FAQ_ID_MISSING")
        .when(later & (F.col("id") == F.col("first.id")), "FAQ_ID_DUPLICATE")
        .when(~whole, "FAQ_EMPTY_QUESTION_OR_ANSWER")
        .when(later, "CHUNK_ID_COLLISION")
    )
    number = F.when(F.col("raw_page").rlike(r"^[+-]?[0-9]+$"), F.expr("try_cast(raw_page AS bigint)"))
    e = e.select("*", code.alias("code"), F.when(number >= 1, number).alias("page"))
    order = Window.partitionBy("faq_source").orderBy("pos")
    text = F.concat(F.lit(f"{SERVICE_TEXT[0]}: "), "question", F.lit(f"\n{SERVICE_TEXT[1]}: "), "answer")
    label = F.nullif(F.regexp_extract("section", PARAGRAPH_LABEL, 0), F.lit(""))
    ok = e.where("code is null").select(
        "faq_source", "pos", F.col("id").alias("faq_id"), "chunk_id", text.alias("text"), F.size(tokenize(text)).alias("token_count"), (F.row_number().over(order) - 1).alias("chunk_index"),
        "section", label.alias("paragraph_label"), "page", F.lag("chunk_id").over(order).alias("prev_chunk_id"), F.lead("chunk_id").over(order).alias("next_chunk_id"), "previous_question", "next_question",
    )
    ends = F.array(F.struct(F.lit("previous").alias("end"), F.col("previous_question").alias("named")), F.struct(F.lit("next").alias("end"), F.col("next_question").alias("named")))
    links = ok.select("faq_source", "pos", "chunk_id", "faq_id", F.inline(ends)).where("named is not null")
    links = links.join(ok.select("faq_source", F.col("faq_id").alias("named"), F.col("chunk_id").alias("target")), ["faq_source", "named"], "left")
    end = lambda x: F.max(F.when(F.col("end") == x, F.col("target"))).alias(f"{x}_question_chunk_id")
    resolved = links.groupBy("faq_source", "pos").agg(end("previous"), end("next"))
    chunks = ok.withColumnsRenamed({"previous_question": "previous_question_id", "next_question": "next_question_id"}).join(resolved, ["faq_source", "pos"], "left")
    missing = links.where("target is null").withColumnRenamed("named", "question_id")
    skipped = e.groupBy("faq_source").agg(F.count_if(F.col("code").isNull()).alias("n")).where("n = 0")
    flags = Z.together(
        Z.flagged(e, "faq_chunker", F.col("code"), "faq_source", "pos", "id", "chunk_id"),
        Z.flagged(e.where("code is null or code = 'CHUNK_ID_COLLISION'").where("raw_page is not null and page is null"), "faq_chunker", "FAQ_PAGE_INVALID", "faq_source", "pos", "id", "raw_page"),
        Z.flagged(missing, "faq_chunker", F.when(F.col("end") == "previous", "PREVIOUS_QUESTION_REFERENCE_MISSING").otherwise("NEXT_QUESTION_REFERENCE_MISSING"), "faq_source", "pos", "chunk_id", "faq_id", "question_id"),
        Z.flagged(skipped, "faq_chunker", "ALL_QUESTIONS_SKIPPED", "faq_source"),
    )
    return chunks, flags
