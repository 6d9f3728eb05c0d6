"""Quality rules with distribution divergence. DataFrame functions only.

Beside the base counts, each document gets histograms of character classes and of common words. The
references are the summed histograms of all documents of a language that pass the base rules and the
length guard, without the document that is judged; a document that is long enough and whose
Jensen-Shannon distance (root of the divergence, base 2) from its language's reference is beyond a limit is not kept.

A language whose other documents have fewer than MIN_REFERENCE words has no reference of its own: its documents are held
against the characters of all languages together, and their words are not judged (the common words of one
language are 0.2 to 0.4 from those of all, so that clean texts would go). With no other document at all there is no
distance, and the base rules alone decide.

Null texts have no words and fail. A null language is a language of its own. Repeated rows count each
time. Other columns are not read. One row per input row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import SPACE, WORD_SPLIT, stored

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Words below which a histogram says too little, and the largest distances of kept documents. On sf0.1 texts
#: without a common word are 0.28 to 0.31 from every language's words, and 0.2 % of those labelled good beyond 0.25.
GUARD_WORDS = 50
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.25

#: Words that the other documents of a language need to be its reference.
MIN_REFERENCE = 2_000

# Frequent function words of English, German, French and Spanish.
COMMON = ("the", "of", "and", "to", "in", "is", "that", "it", "der", "die", "und", "zu", "den", "das", "mit", "von", "la", "de", "le", "et", "les", "des", "que", "un", "el", "y", "en", "los", "por", "con", "para", "una")
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "blank": SPACE, "stop": ".,;:!?'\"()-", "symbol": r"#*$%&|<>{}\[\]=+/\\^~_@`"}


def _left(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"[{chars}]+", "")


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts, and the histograms classes and words (arrays of long).

    Most characters are lower-case letters or blanks: what lies between words is all blanks, and the
    other classes are counted on what is left without lower-case letters.
    """
    t = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.select("doc_id", "lang", "text", F.array_remove(F.split("text", WORD_SPLIT, -1), "").alias("w"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("ln"))
    t = t.select("*", F.size("w").alias("n"), F.array_join("w", "").alias("solid"), F.transform("w", lambda x: F.xxhash64(x)).alias("g"), F.filter(F.transform("w", lambda x: F.lower(x)), lambda x: x.isin(*COMMON)).alias("known"))
    hashes = F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("g", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    t = t.withColumns({"h": hashes, "rest": _left(F.col("solid"), "a-z")})
    t = t.withColumn("q", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i: (x["h"] == F.get("q", i - 1)["h"]) | (x["h"] == F.get("q", i + 1)["h"])
    t = t.withColumn("at", F.sort_array(F.transform(F.filter("q", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    repeated = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    chars, solid, rest = F.length("text").cast("long"), F.length("solid").cast("long"), F.length("rest").cast("long")
    of_class = {"lower": solid - rest, "blank": chars - solid}
    classes = [of_class[k] if k in of_class else (rest - F.length(_left(F.col("rest"), c))).cast("long") for k, c in CLASSES.items()]
    hits = [(F.size("known") - F.size(F.array_remove("known", w))).cast("long") for w in COMMON]
    t = t.select(
        "doc_id", "lang", F.col("n").cast("long").alias("n_words"), solid.alias("word_chars"),
        (rest - F.length(_left(F.col("rest"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*classes).alias("c"), F.array(*hits).alias("k"), chars.alias("chars"),
    )
    rest_of = lambda total, a: F.array_append(a, F.greatest(total - F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return t.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), rest_of(F.col("chars"), F.col("c")).alias("classes"), rest_of(F.col("n_words"), F.col("k")).alias("words"))


def _long_and_clean() -> Column:
    return ~F.col("base_failed") & (F.col("n_words") >= GUARD_WORDS)


def references(found: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_words): summed histograms of a language's long enough documents that pass the base rules."""
    n, m = len(CLASSES) + 1, len(COMMON) + 1
    sums = found.where(_long_and_clean()).groupBy("lang").agg(*[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n)], *[F.sum(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(m)])
    return sums.select("lang", F.array(*[f"c{i}" for i in range(n)]).alias("ref_classes"), F.array(*[f"w{i}" for i in range(m)]).alias("ref_words"))


def against(found: DataFrame) -> DataFrame:
    """found with ref_classes and ref_words: what its row is judged by, itself left out; ref_words is null where its language is too small."""
    refs = stored(references(found), "references")  # a row for each language
    together = refs.agg(F.array(*[F.sum(F.get("ref_classes", F.lit(i))) for i in range(len(CLASSES) + 1)]).alias("all_classes"))
    own = lambda h: F.transform(h, lambda x: F.when(_long_and_clean(), x).otherwise(F.lit(0).cast("long")))
    without = lambda ref, h: F.zip_with(ref, own(h), lambda x, y: x - y)
    met = found.join(refs, "lang", "left").crossJoin(F.broadcast(together))  # one row is broadcast
    met = met.withColumn("ref_words", without("ref_words", "words"))
    met = met.withColumn("ref_words", F.when(F.aggregate("ref_words", F.lit(0).cast("long"), lambda x, y: x + y) >= MIN_REFERENCE, F.col("ref_words")))
    return met.withColumn("ref_classes", without(F.when(F.col("ref_words").isNull(), F.col("all_classes")).otherwise(F.col("ref_classes")), "classes")).drop("all_classes")


def distance(a: str, b: str) -> Column:
    """Jensen-Shannon distance of two histograms; null if one is empty or missing."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    ta, tb = total(F.col(a)), total(F.col(b))
    terms = F.zip_with(F.transform(a, lambda x: x / ta), F.transform(b, lambda x: x / tb), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.when((ta > 0) & (tb > 0), F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0))))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """counts() without histograms, then class_distance, word_distance (double) and kept."""
    found = stored(counts(df, id_col, text_col, lang_col), "quality")
    far = against(found).withColumns({"class_distance": distance("classes", "ref_classes"), "word_distance": distance("words", "ref_words")})
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    kept = ~F.col("base_failed") & ((F.col("n_words") < GUARD_WORDS) | near)
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance")
