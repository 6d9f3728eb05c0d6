"""Token-bounded, heading-aware chunks of sections and tables.

A section is one row, so chunking is a narrow, row-wise step: no shuffle, whatever the number of
documents. The sequential rules (windows, merges, packing) run per section in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX, MIN, OVERLAP = 512, 64, 50
CHUNKS = "doc_id string, section_id string, chunk_id string, chunk_type string, text string, token_count int, chunk_index int"


class Words:
    """The default tokenizer: white-space words. Any object with encode and decode will do."""

    def encode(self, text: str) -> list:
        return text.split()

    def decode(self, ids: list) -> str:
        return " ".join(ids)


class BytePairs:
    """Byte-pair tokenizer of a file of ranks in the tiktoken format."""

    # Fixed value: the public word pattern of such vocabularies.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

    def __init__(self, path: str, pattern: str = PATTERN):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.table = tiktoken.Encoding(name=path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list:
        return self.table.encode_ordinary(text)

    def decode(self, ids: list) -> str:
        return self.table.decode(list(ids))


def split_sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text)) if s]


def prepared(text: str, limit: int, tk) -> tuple[list[str], list[int]]:
    """Sentences, those over the limit cut into runs of limit tokens, and their token counts."""
    out: list[str] = []
    for s in split_sentences(text):
        ids = tk.encode(s)
        out += [s] if len(ids) <= limit else [p for p in (tk.decode(ids[i : i + limit]).strip() for i in range(0, len(ids), limit)) if p]
    return out, [len(tk.encode(s)) for s in out]


def windows(counts: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of greedy windows; a joining blank costs one token. The next window starts at the earliest
    sentence after this start from which the rest of the window holds at most overlap tokens."""
    out, start, n = [], 0, len(counts)
    while start < n:
        end, used = start + 1, counts[start]
        while end < n and used + 1 + counts[end] <= limit:
            used += 1 + counts[end]
            end += 1
        out.append((start, end))
        if end >= n:
            break
        back, kept = end, 0
        while back - 1 > start and kept + counts[back - 1] <= overlap:
            back -= 1
            kept += counts[back]
        start = back
    return out


def merged(chunks: list[str], least: int, limit: int, size: Callable[[str], int], last_only: bool = False) -> list[str]:
    """Chunks under least grow by the ones after them as long as that fits, else (last_only: the last one) join the one before, else stay."""
    out: list[str] = []
    held = ""
    for text, after in zip(chunks, [*chunks[1:], None]):
        held = f"{held} {text}" if held else text
        if size(held) < least:
            if after is not None and size(f"{held} {after}") <= limit:
                continue
            if out and not (last_only and after is not None) and size(f"{out[-1]} {held}") <= limit:
                out[-1] = f"{out[-1]} {held}"
                held = ""
                continue
        out.append(held)
        held = ""
    return out


def packed_rows(headers: list[str], rows: list[list[str]], limit: int, size: Callable[[str], int]) -> list[list[str]]:
    """Lines of table chunks within limit tokens: the header, if it leaves room for rows, then rows that cost a token more each.

    A row that does not fit below the header is a chunk of its own, without it.
    """
    line = lambda cells: " | ".join(c.strip() for c in cells if c and c.strip())
    title = line(headers or [])
    room = limit - (size(f"{title}\n") if title else 0)
    if room <= 0:
        title, room = "", limit
    packs: list[list[str]] = []
    left = 0  # what the last pack still takes; 0 as well if it is closed
    for text in filter(None, map(line, rows or [])):
        cost = size(text)
        if cost > room:
            packs.append([text])
            left = 0
        elif left and cost + 1 <= left:
            packs[-1].append(text)
            left -= cost + 1
        else:
            packs.append([title, text] if title else [text])
            left = room - cost - 1
    return packs


def headings(sections: DataFrame, separator: str = " > ", most: int = 10) -> DataFrame:
    """sections with heading_path (array) and heading: labels and titles from the topmost ancestor to the section itself, most of them at most.

    Every section knows a stretch of its way up and where it goes on; a round joins each with the
    stretch of the section it goes on at and so doubles both, so the rounds are the logarithm of most. A way
    that loops ends after most sections, as any does. Of sections that share an id the
    last by label and title is the parent of others. Ids are those of a document.
    """
    own = F.trim(F.concat_ws(" ", F.nullif(F.trim("label"), F.lit("")), F.nullif(F.trim("title"), F.lit(""))))
    blank = lambda c: F.nullif(c, F.lit(""))
    named = sections.select("doc_id", "section_id", F.struct(own.alias("name"), blank(F.col("parent_section_id")).alias("up")).alias("x"))
    ways = named.groupBy("doc_id", "section_id").agg(F.max("x").alias("x")).select("doc_id", "section_id", F.array("x.name").alias("way"), F.col("x.up").alias("up"))
    reach = 1
    while reach < most:
        on = ways.select("doc_id", F.col("section_id").alias("up"), F.col("way").alias("_way"), F.col("up").alias("_up"))
        further = F.slice(F.concat("way", F.coalesce("_way", F.array().cast("array<string>"))), 1, most)
        ways, reach = ways.join(on, ["doc_id", "up"], "left").select("doc_id", "section_id", further.alias("way"), F.col("_up").alias("up")), 2 * reach
    above = ways.select("doc_id", F.col("section_id").alias("_at"), F.col("way").alias("_above"))
    path = F.slice(F.concat(F.array(own), F.coalesce("_above", F.array().cast("array<string>"))), 1, most)
    made = sections.withColumn("_at", blank(F.col("parent_section_id"))).join(above, ["doc_id", "_at"], "left")
    made = made.withColumn("heading_path", F.filter(F.reverse(path), lambda x: x != "")).drop("_at", "_above")
    return made.withColumn("heading", F.array_join("heading_path", separator))


def chunk_sections(sections: DataFrame, limit: int = MAX, least: int = MIN, overlap: int = OVERLAP, tokenizer: Callable[[], object] = Words) -> DataFrame:
    """Text and table chunks of sections(doc_id, section_id, heading, text[, tables])."""
    if not 0 < least <= limit or not 0 <= overlap < limit:
        raise ValueError("limits must satisfy 0 < least <= limit and 0 <= overlap < limit")
    have_tables = "tables" in sections.columns

    def one(tk, doc, section, heading, text, tables) -> Iterator[tuple]:
        size = lambda s: len(tk.encode(s))
        prefix = f"{heading}\n\n" if heading else ""
        room = limit - size(prefix)
        if room <= 0:
            prefix, room = "", limit
        sentences, counts = prepared(text or "", room, tk)
        bodies = merged([" ".join(sentences[a:b]) for a, b in windows(counts, room, overlap)], least, room, size)
        for i, body in enumerate(bodies):
            ids = tk.encode(body)
            full = prefix + (body if len(ids) <= room else tk.decode(ids[:room]))
            yield doc, section, f"{section}-txt-{i + 1}", "text", full, size(full), i
        for t in tables if tables is not None else ():
            for j, lines in enumerate(packed_rows(list(t["headers"] if t["headers"] is not None else []), [list(r) for r in (t["rows"] if t["rows"] is not None else [])], room, size)):
                body = "\n".join(lines)
                ids = tk.encode(body) if prefix else ()
                full = prefix + (body if len(ids) <= room else tk.decode(ids[:room]))
                yield doc, section, f"{section}-tbl-{t['table_id']}-{j + 1}", "table", full, size(full), len(bodies) + j

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tk = tokenizer()
        names = [c.split(" ")[0] for c in CHUNKS.split(", ")]
        for b in batches:
            cols = [b["doc_id"], b["section_id"], b["heading"], b["text"], b["tables"] if have_tables else [None] * len(b)]
            yield pd.DataFrame([r for row in zip(*cols) for r in one(tk, *row)], columns=names)

    cols = [F.col("doc_id").cast("string").alias("doc_id"), F.col("section_id").cast("string").alias("section_id"), "heading", "text", *(["tables"] if have_tables else [])]
    return sections.select(*cols).mapInPandas(run, CHUNKS)


def token_stats(chunks: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), n(F.min("token_count")).alias("min_tokens"), n(F.floor(F.median("token_count"))).alias("median_tokens"), n(F.max("token_count")).alias("max_tokens"), n(F.sum("token_count")).alias("total_tokens"))


def chunked(sections: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(chunks, flags) of chunk_sections(); empty sections give a flag."""
    from ravelin.operators.flags import flagged

    empty = (F.coalesce(F.trim("text"), F.lit("")) == "") & ((F.coalesce(F.size("tables"), F.lit(0)) <= 0) if "tables" in sections.columns else F.lit(True))
    return chunk_sections(sections.where(~empty), **limits), flagged(sections.where(empty), "pdf_chunker", "SECTION_EMPTY", "doc_id", "section_id")


def section_flags(sections: DataFrame) -> DataFrame:
    empty = (F.coalesce(F.trim("text"), F.lit("")) == "") & ((F.coalesce(F.size("tables"), F.lit(0)) <= 0) if "tables" in sections.columns else F.lit(True))
    return sections.where(empty).select("doc_id", "section_id", F.lit("SECTION_EMPTY").alias("code"), F.lit("info").alias("severity"))


def serialized_row(cells):
    """A table row as one line: trimmed cells, none empty."""
    return F.array_join(F.filter(F.transform(cells, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), " | ")


def linked(chunks: DataFrame, order: str = "pos") -> DataFrame:
    """The service's ids and neighbours: ch_000001 in order, with the chunks before and after within a document."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id").orderBy(order)
    made = chunks.withColumn("chunk_id", F.concat(F.lit("ch_"), F.lpad(F.row_number().over(w).cast("string"), 6, "0")))
    return made.withColumns({"prev_chunk_id": F.lag("chunk_id").over(w), "next_chunk_id": F.lead("chunk_id").over(w)})
