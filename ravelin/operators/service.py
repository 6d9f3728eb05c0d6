"""The service's chunking: sentences packed by the length of what they join to, token overlap, headings, tables without a header line.

Sections are chunked one row at a time in Arrow batches; ids, places and neighbours are windows over each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators import chunking as C
from ravelin.operators import flags as Z

LEAST_BODY = 32
MADE = "doc_id string, section_id string, table_id string, pos long, place int, text string, token_count int, flags array<struct<code:string,number:int>>"


def pieces(text: str, limit: int, tk) -> tuple[list[str], list[tuple[str, int]]]:
    """Sentences packed into chunks of limit tokens, counted on what they join to; longer ones are cut, with a flag each."""
    out: list[str] = []
    notes: list[tuple[str, int]] = []
    for s in C.split_sentences(text):
        ids = tk.encode(s)
        parts = [s] if len(ids) <= limit else [p for p in (tk.decode(ids[i : i + limit]).strip() for i in range(0, len(ids), limit)) if p]
        if len(parts) > 1:
            notes.append(("OVERSIZED_SENTENCE_SPLIT", len(parts)))
        for p in parts:
            if out and len(tk.encode(f"{out[-1]} {p}")) <= limit:
                out[-1] = f"{out[-1]} {p}"
            else:
                out.append(p)
    return out, notes


def headed(bodies: list[str], heading: str, limit: int, overlap: int, tk) -> tuple[list[str], list[tuple[str, int]]]:
    """Each body below the heading, after as much of the end of the body before as overlap and limit allow."""
    head = tk.encode(heading) if heading else []
    room, notes = limit - len(head), []
    if room <= 0 and bodies:
        room, notes = limit, [("HEADING_TOO_LONG", len(head))]
    out, last = [], []
    for i, body in enumerate(bodies):
        ids = tk.encode(body)
        if len(ids) > room:
            ids = ids[:room]
            notes.append(("CHUNK_TRIMMED_FOR_HEADING", i))
        spare = min(overlap, room - len(ids))
        text = tk.decode([*head, *(last[-spare:] if spare > 0 else []), *ids]).strip()
        if text:
            out.append(text)
        last = ids
    return out, notes


def table_texts(rows: list[list[str]], heading: str, limit: int, tk) -> tuple[list[str], list[tuple[str, int]]]:
    """Rows packed below the heading, without a header line; a row that is too long is cut into pieces of its own."""
    head = tk.encode(heading) if heading else []
    room, notes = limit - len(head), []
    if room <= 0:
        room, notes = limit, [("TABLE_HEADING_TOO_LONG", len(head))]
    out: list[str] = []
    growing = False
    for line in (" | ".join(c.strip() for c in row if c and c.strip()) for row in rows):
        ids = tk.encode(line) if line else []
        if not line:
            continue
        if len(ids) > room:
            out += [p for p in (tk.decode(ids[i : i + room]).strip() for i in range(0, len(ids), room)) if p]
            notes.append(("TABLE_ROW_SPLIT", len(ids)))
            growing = False
        elif growing and len(tk.encode(f"{out[-1]}\n{line}")) <= room:
            out[-1] = f"{out[-1]}\n{line}"
        else:
            out.append(line)
            growing = True
    if not out:
        return [], []
    return [t for t in ((tk.decode([*head, *tk.encode(x)[:room]]).strip() if head else x) for x in out) if t.strip()], notes


def chunked(sections: DataFrame, tables: DataFrame, limit: int = C.MAX, least: int = C.MIN, overlap: int = C.OVERLAP, tokenizer: Callable[[], object] = C.Words) -> tuple[DataFrame, DataFrame]:
    """(chunks, flags) of sections(doc_id, section_id, seq, kind, heading, text) and tables(doc_id, table_id, seq, section_id, rows).

    Only paragraphs and annexes give text. Chunks are numbered within a document, texts before tables, and
    counted within a section; each names the one before and after in its section or table.
    """
    of_text = sections.where(F.col("kind").isin("paragraph", "annex", "appendix"))
    full = of_text.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    named = tables.join(sections.select("doc_id", "section_id", "heading", F.lit(True).alias("known")), ["doc_id", "section_id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tk = tokenizer()
        names = [c.split(" ")[0] for c in MADE.split(", ")]
        for b in batches:
            out = []
            for doc, section, table, pos, heading, text, rows in zip(*(b[c] for c in ("doc_id", "section_id", "table_id", "pos", "heading", "text", "rows"))):
                prefix = f"{heading}\n\n" if isinstance(heading, str) and heading else ""
                if pd.isna(table):
                    most = max(LEAST_BODY, limit - len(tk.encode(prefix)))
                    bodies, notes = pieces(text, most, tk)
                    made, more = headed(C.merged(bodies, max(1, min(least, most)), most, lambda s: len(tk.encode(s)), last_only=True), prefix, limit, overlap, tk)
                    notes += more
                else:
                    made, notes = table_texts([list(r) for r in rows], prefix, limit, tk)
                out += [(doc, section, table, pos, i, t, len(tk.encode(t)), notes if i == 0 else []) for i, t in enumerate(made)]
                if notes and not made:
                    out.append((doc, section, table, pos, -1, "", 0, notes))
            yield pd.DataFrame(out, columns=names)

    cols = lambda rows, *more: rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("section_id").cast("string").alias("section_id"), *more)
    empty = F.array().cast("array<array<string>>")
    inputs = cols(full, F.lit(None).cast("string").alias("table_id"), F.col("seq").cast("long").alias("pos"), "heading", "text", empty.alias("rows"))
    inputs = inputs.unionByName(cols(named, F.col("table_id").cast("string").alias("table_id"), F.col("seq").cast("long").alias("pos"), F.when(F.col("known"), F.col("heading")).alias("heading"), F.lit("").alias("text"), F.coalesce("rows", empty).alias("rows")))
    made = inputs.mapInPandas(run, MADE)
    order = [F.col("table_id").isNotNull(), "pos", "place"]
    every, own = Window.partitionBy("doc_id").orderBy(*order), Window.partitionBy("doc_id", "section_id").orderBy(*order)
    near = Window.partitionBy("doc_id", "section_id", "table_id").orderBy("place")
    chunks = made.where("place >= 0").withColumn("chunk_id", F.concat(F.lit("ch_"), F.lpad(F.row_number().over(every).cast("string"), 6, "0")))
    chunks = chunks.withColumns({"chunk_type": F.when(F.col("table_id").isNull(), "text").otherwise("table"), "chunk_index": F.row_number().over(own) - 1, "prev_chunk_id": F.lag("chunk_id").over(near), "next_chunk_id": F.lead("chunk_id").over(near)})
    notes = made.select("doc_id", "section_id", "table_id", F.inline("flags"))
    small = chunks.where(F.col("token_count") < least).groupBy("doc_id", "chunk_type").agg(F.count(F.lit(1)).alias("count"))
    none = sections.groupBy("doc_id").agg(F.count_if(F.col("kind").isin("paragraph", "annex", "appendix")).alias("n")).where("n = 0")
    flags = Z.together(
        Z.flagged(notes, "pdf_chunker", F.col("code"), "doc_id", "section_id", "table_id", "number"),
        Z.flagged(none, "pdf_chunker", "NO_TEXT_SECTIONS", "doc_id"),
        Z.flagged(of_text.where(F.trim(F.coalesce("text", F.lit(""))) == ""), "pdf_chunker", "SECTION_EMPTY_SKIPPED", "doc_id", "section_id"),
        Z.flagged(named.where("known is null"), "pdf_chunker", "TABLE_WITHOUT_SECTION", "doc_id", "table_id"),
        Z.flagged(small, "pdf_chunker", F.when(F.col("chunk_type") == "text", "TEXT_CHUNKS_BELOW_MIN").otherwise("TABLE_CHUNKS_BELOW_MIN"), "doc_id", "count"),
    )
    return chunks.drop("flags", "place", "pos"), flags
