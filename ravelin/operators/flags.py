"""Diagnostics as a side output: every stage gives (stage, code, severity, context) beside its rows, instead of failing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes of all stages by severity.
ERRORS = "ALL_QUESTIONS_SKIPPED CHUNK_ID_COLLISION EMPTY_DOCUMENT FAQ_ALL_SKIPPED HEADING_TOO_LONG LLM_CALL_FAILED LLM_OUTPUT_INVALID SOURCE_CHUNKS_INVALID SOURCE_FILE_READ_ERROR".split()
WARNINGS = """BACKEND_DOCUMENT_ID_MISMATCH BACKEND_FAILED BACKEND_HITS_INVALID BACKEND_HTTP_ERROR BACKEND_UNREACHABLE CHUNK_ID_DUPLICATE CHUNK_ID_MISSING
CHUNK_RECORD_INVALID CONTEXT_EMPTY_AFTER_BUDGETING FAQ_EMPTY_ANSWER FAQ_EMPTY_QUESTION FAQ_EMPTY_QUESTION_OR_ANSWER FAQ_ENTRY_INVALID FAQ_ID_DUPLICATE
FAQ_ID_MISSING HYBRID_NO_HITS MISSING_DOCUMENT_TYPE MISSING_FACULTY MISSING_INSTITUTION MISSING_TITLE MISSING_VERSION_DATE NO_MARKERS_FOUND NO_TEXT_SECTIONS
ORPHAN_PARAGRAPH QUERY_EMPTY_AFTER_TOKENIZATION QUESTION_ITEM_NOT_OBJECT SOURCE_HAS_NO_VALID_CHUNKS SYNTOK_UNAVAILABLE TABLE_DETECTION_FAILED
TABLE_HEADING_TOO_LONG TOC_NOT_FOUND TOC_PARSE_EMPTY UNASSIGNED_TABLE VECTOR_ID_DUPLICATE VECTOR_ID_NOT_IN_STATE""".split()
INFOS = """BACKEND_HIT_INVALID BACKEND_HIT_KEY_INVALID CHUNK_EMPTY_AFTER_TOKENIZATION CHUNK_TEXT_EMPTY CHUNK_TRIMMED_FOR_HEADING DUPLICATE_PARAGRAPH_MARKER_SKIPPED
EMPTY_TABLE_SKIPPED FAQ_OVERSIZED_ENTRY FAQ_PAGE_INVALID HYBRID_SINGLE_BACKEND_EVIDENCE LLM_REASONING NEXT_QUESTION_REFERENCE_MISSING OVERSIZED_SENTENCE_SPLIT
PREVIOUS_QUESTION_REFERENCE_MISSING SECTION_EMPTY SECTION_EMPTY_SKIPPED SOURCE_FILE_MISSING SPARSE_NO_HITS TABLE_CHUNKS_BELOW_MIN TABLE_ROW_SPLIT
TABLE_WITHOUT_SECTION TEXT_CHUNKS_BELOW_MIN VECTOR_NO_HITS""".split()
SEVERITY = {c: s for s, codes in (("error", ERRORS), ("warning", WARNINGS), ("info", INFOS)) for c in codes}


def severity(code: Column) -> Column:
    """The severity of a code; unknown codes are warnings."""
    return F.when(code.isin(ERRORS), "error").when(code.isin(INFOS), "info").otherwise("warning")


def flagged(rows: DataFrame, stage: str, code: str | Column, *context: str) -> DataFrame:
    """A flag for every row, with the columns context as a JSON object; a row without a code has none."""
    c = F.lit(code) if isinstance(code, str) else code
    made = rows.select(F.lit(stage).alias("stage"), c.alias("code"), severity(c).alias("severity"), F.to_json(F.struct(*context)).alias("context") if context else F.lit("{}").alias("context"))
    return made.where("code is not null")


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def propagated(flags: DataFrame, backend: str) -> DataFrame:
    """A backend's flags under its prefix; severities that are none become warnings."""
    known = F.col("severity").isin("info", "warning", "error")
    return flags.withColumn("code", F.concat(F.lit(f"{backend.upper()}_"), F.col("code"))).withColumn("severity", F.when(known, F.col("severity")).otherwise("warning"))
