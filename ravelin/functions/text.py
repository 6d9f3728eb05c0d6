"""Text functions as column expressions: tokenizers, clean-up, numerals, dates, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The German stop words of the regular-expression tokenizer.
GERMAN_STOPWORDS = """aber als am an auch auf aus bei bin bis da dadurch daher darum das daß dass dein deine dem den der des dessen
deshalb die dies dieser dieses doch dort du durch ein eine einem einen einer eines er es euer eure für hatte hatten hattest hattet hier
hinter ich ihr ihre im in ist ja jede jedem jeden jeder jedes jener jenes jetzt kann kannst koennen können machen mein meine mit muss
musst muessen müssen nach nachdem nein nicht nun oder seid sein seine sich sie sind soll sollen sollst sonst soweit sowie und unser
unsere unter vom von vor wann warum was weiter wenn wer werde werden wie wieder wieso wir wird wirst wo woher wohin zu zum zur
zwischen""".split()

# Month names of German dates.
GERMAN_MONTHS = {"januar": 1, "februar": 2, "maerz": 3, "märz": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12}


def tokens(c: Column | str) -> Column:
    """Lower-case words between Unicode white space; punctuation stays."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+", -1), lambda x: x != "")


def tokens_german(c: Column | str, min_length: int = 2, stopwords: bool = True, numeric: bool = True) -> Column:
    """Letters-and-digits tokens, paragraph signs spelled out, stop words and short words left out; numbers stay if numeric."""
    spelled = F.lower(F.regexp_replace(c, r"§\s*([0-9]+[a-zA-Z]?)", " paragraf $1 "))
    found = F.regexp_extract_all(spelled, F.lit("([A-Za-z0-9ÄÖÜäöüß]+)"), F.lit(1))
    number = lambda x: x.rlike("^[0-9]+$")
    word = lambda x: (F.length(x) >= min_length) & (~x.isin(GERMAN_STOPWORDS) if stopwords else F.lit(True))
    return F.filter(found, lambda x: F.when(number(x), F.lit(numeric)).otherwise(word(x)))


def without_page_number(c: Column, page: Column) -> Column:
    """After page 1, a first line of one or two digits goes."""
    return F.when(page > 1, F.regexp_replace(c, r"\A[ \t]*\d{1,2}[ \t]*(?:\n|\z)", "")).otherwise(c)


def tidy(c: Column) -> Column:
    """Lines right-trimmed, runs of blank lines made one, ends trimmed."""
    lines = F.regexp_replace(c, r"[ \t\r\f\x0B]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def dehyphenated(c: Column) -> Column:
    """Words joined across line ends, white space of a line collapsed, blank lines dropped."""
    joined = F.regexp_replace(c, r"(\w)-\n(\w)", "$1$2")
    lines = F.transform(F.split(joined, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def joined_lines(c: Column) -> Column:
    """As dehyphenated(), but only letters are joined, German ones too, whatever blanks stand at the line's end."""
    letter = "[A-Za-zÄÖÜäöüß]"
    joined = F.regexp_replace(c, rf"({letter})-\s*\n\s*({letter})", "$1$2")
    lines = F.transform(F.split(joined, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def sentences(c: Column) -> Column:
    """Parts that follow a full stop, exclamation or question mark and white space, trimmed, none empty."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+", -1), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), lambda x: x != "")


def roman(c: Column) -> Column:
    """Value of a roman numeral by the subtractive rule; null if it is none."""
    value = F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv])
    up = F.upper(c)
    digits = F.transform(F.filter(F.split(F.reverse(up), ""), lambda x: x != ""), lambda x: F.element_at(value, x))
    state = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    total = F.aggregate(digits, state, lambda a, v: F.struct((a["sum"] + F.when(v < a["last"], -v).otherwise(v)).alias("sum"), F.greatest(a["last"], v).alias("last")), lambda a: a["sum"])
    return F.when(up.rlike("^[IVXLCDM]+$"), total)


def german_date(c: Column) -> Column:
    """d.m.yyyy, d.m.yy (20yy) or d. Monat yyyy; null if there is no such date."""
    dotted = r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})"
    named = r"(\d{1,2})\.\s*([A-Za-zÄÖÜäöüß]+)\s*(\d{4})"
    months = F.create_map(*[F.lit(x) for kv in GERMAN_MONTHS.items() for x in kv])
    year = F.regexp_extract(c, dotted, 3)
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    by_dots = made(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), F.regexp_extract(c, dotted, 2), F.regexp_extract(c, dotted, 1))
    by_name = made(F.regexp_extract(c, named, 3), F.try_element_at(months, F.lower(F.regexp_extract(c, named, 2))), F.regexp_extract(c, named, 1))
    return F.when(c.rlike(dotted), by_dots).when(c.rlike(named), by_name)


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def flat_metadata(c: Column, kind: str) -> Column:
    """One metadata value as the dense index keeps it: null is empty, lists are joined, scalars stay."""
    return F.coalesce(F.array_join(c, " > "), F.lit("")) if kind.startswith("array") else F.coalesce(c.cast("string"), F.lit(""))
