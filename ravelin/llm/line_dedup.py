"""Cross-site boilerplate removal by the distinct-site spread of lines. DataFrame functions only.

A line counts by its text without outer white space, if it has at least min_words words (one by default). A HyperLogLog
sketch of the sites of each line hash is merged by the aggregation itself (map side first, so a line
or site of any share is one row per task). Lines whose estimate is near the threshold get an exact
distinct count, over distinct pairs of line and site; lines clearly beyond it are boilerplate at once.
Both ends of the band lie four standard errors (ERROR of the true number) from the threshold, so that
about one line in thirty thousand of those just at it is misjudged by its sketch. Boilerplate lines are removed from
every document, unless they make up more than MAX_SHARE of its characters: that is a copy of another
document, not a page with boilerplate, and is left whole for near-duplicate detection.

Null texts are empty; a null site is one site of its own. Rows that repeat an id are treated by their
own text. Line hashes have 128 bits. Other columns pass through apply() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import SPACE, stored

MIN_SITES = 8
MIN_WORDS = 1
MAX_SHARE = 0.5
#: Standard error of the sketches, and the band of estimates (as shares of the threshold) that is counted exactly.
ERROR, BAND = 0.1, 0.4

BLANKS = " \t\n\x0b\f\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def lines(text: Column, min_words: int = MIN_WORDS) -> Column:
    """Lines of a text that count, trimmed, each once."""
    several = f"[^{SPACE}]" + f"[{SPACE}]+[^{SPACE}]+" * (min_words - 1) if min_words > 1 else f"[^{SPACE}]"
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda x: x.rlike(several)))


def key(line: Column) -> list[Column]:
    """128 bits of a line: two XXH64 of different seeds (a constant in front is hashed into the seed)."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2): hashes of the lines that stand on min_sites or more distinct sites."""
    found = docs.select(F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.explode(lines(F.coalesce(text_col, F.lit("")), min_words)).alias("line")).select("site", *key(F.col("line")))
    spread = stored(found.groupBy("k1", "k2").agg(F.approx_count_distinct("site", ERROR).alias("n")).where(F.col("n") >= min_sites * (1 - BAND)), "spread")
    far = F.col("n") > min_sites * (1 + BAND)
    exact = found.join(spread.where(~far).select("k1", "k2"), ["k1", "k2"], "left_semi").distinct().groupBy("k1", "k2").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    return spread.where(far).select("k1", "k2").unionByName(exact.select("k1", "k2"))


def apply(df: DataFrame, min_sites: int = MIN_SITES, max_share: float = MAX_SHARE, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of df with the text column cleaned, then n_lines, n_boilerplate, n_removed (lines; long)."""
    names = [c for c in df.columns if c not in ("n_lines", "n_boilerplate", "n_removed")]
    bad = stored(boilerplate(df, site_col, text_col, min_sites, min_words), "boilerplate")
    marks = (
        df.select(F.col(id_col).alias("_id"), F.explode(lines(F.coalesce(text_col, F.lit("")), min_words)).alias("line"))
        .select("_id", *key(F.col("line")))
        .join(bad, ["k1", "k2"])
        .groupBy("_id")
        .agg(F.collect_set(F.struct("k1", "k2")).alias("_bad"))
    )
    held = df.select(F.struct(*names).alias("_row"))  # so that no column of df can clash with those made here
    text = F.col("_row")[text_col]
    rows = held.join(marks, F.col("_row")[id_col].eqNullSafe(F.col("_id")), "left").select("_row", "_bad", F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("_lines"))
    is_bad = lambda x: F.array_contains("_bad", F.struct(*key(trimmed(x))))
    rows = rows.withColumn("_cut", F.when(F.col("_bad").isNotNull(), F.filter("_lines", lambda x: ~is_bad(x))).otherwise(F.col("_lines")))
    size = lambda c: F.length(F.array_join(c, ""))
    whole = F.col("_bad").isNull() | (size("_lines") - size("_cut") > F.lit(max_share) * size("_lines"))
    n, cut = F.size("_lines").cast("long"), F.size("_cut").cast("long")
    return rows.select(
        *[F.when(whole, text).otherwise(F.array_join("_cut", "\n")).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names],
        n.alias("n_lines"), (n - cut).alias("n_boilerplate"), F.when(whole, F.lit(0)).otherwise(n - cut).cast("long").alias("n_removed"),
    )


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, site, unnest(list_transform(ls, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS line FROM d),
bad AS (SELECT line FROM e WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
p AS (SELECT doc_id, ls, i, ls[i] AS raw, trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) IN (SELECT line FROM bad) AS gone
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_boilerplate, sum(length(raw)) AS chars, coalesce(sum(length(raw)) FILTER (gone), 0) AS cut_chars,
      string_agg(raw, chr(10) ORDER BY i) AS whole, string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone) AS cut FROM p GROUP BY doc_id)
SELECT doc_id, n_lines, n_boilerplate, CASE WHEN n_boilerplate = 0 OR cut_chars > {MAX_SHARE} * chars THEN 0 ELSE n_boilerplate END AS n_removed,
  sha256(CASE WHEN n_boilerplate = 0 OR cut_chars > {MAX_SHARE} * chars THEN whole ELSE coalesce(cut, '') END) AS text_sha256 FROM g
"""
