"""Personal data by weak supervision. DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks. Looser patterns propose
further candidates (handles spelled with (at), local phone numbers, numbers in the form of a social
security number, secrets, titled names). Three labelers vote on each candidate: the shape (regex), a
gazetteer of words inside or right before it, and the context of the CONTEXT characters before it.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for
each kind, and the resulting posteriors are the soft labels of the final span classifier, a naive
Bayes model over kind, votes, length and character make-up. Only its two tables of counts, whose
sizes are fixed by the numbers of kinds, votes and buckets, reach the driver. A candidate that the
classifier takes for personal data, and that overlaps no base span, is added.

Positions are code points, end exclusive. Null texts are empty. Repeated rows count each time in the
estimates. Other columns are not read. With no candidates at all nothing is added.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import stored, texts

CONTEXT = 24
ROUNDS = 40
#: Weight of a vote that the model has not seen, and of the classifier's counts.
SMOOTHING = 1.0
MIN_POSTERIOR = 0.5

BASE = ("email", "ip", "card", "phone")
# \G is the end of the match before: a match starts at its run's first character or there.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = {
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63}+){1,8}",
    "local_phone": r"(?<![0-9+A-Za-z.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])",
    "social": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}+(?![A-Za-z0-9_/+=-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{L}{1,30}+(?:\x20\p{Lu}\p{L}{1,30}+)?",
}
SHAPES = {
    "handle": r"[(\[]at[)\]].*(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z]{2,}$",
    "local_phone": r"^(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})",
    "social": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "secret": r"^(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z])",
    "name": r"\x20\p{Lu}\p{L}+$",
}
# Words that speak for personal data, inside a candidate or within the context before it.
GAZETTEER = {
    "handle": r"(?i)\b(?:com|org|net|edu|info|de|fr|es|uk|gmail|mail|example)\b",
    "local_phone": r"(?:^\(?(?:2|3|4|5|6|7|8|9)[0-9]{2}\)?).*555|^\(",
    "social": r"^(?:0(?!00)|[1-7])",
    "secret": r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|AIza|[0-9a-f]{32,128}$)",
    "name": r"\b(?:James|John|Mary|Anna|Peter|Paul|Maria|Jean|Pierre|Hans|Carlos|Juan|Michael|Thomas|Laura|Julia|David|Sarah)\b",
}
CUES = {
    "handle": r"(?i)(?:mail|contact|write|reach|address|kontakt|correo|courriel)\W*(?:\w+\W+)?$",
    "local_phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|ruf|appel|llam)\w*\W*(?:\w+\W+)?$",
    "social": r"(?i)(?:ssn|social|security|tax|id)\W*(?:\w+\W+)?$",
    "secret": r"(?i)(?:token|key|secret|passw\w*|pwd|bearer|auth\w*|credential\w*)[\x20\"'=:]+$",
    "name": r"(?i)(?:name|contact|by|from|dear|signed|von|par|por)\W*(?:\w+\W+)?$",
}
ORDER = (*BASE, *CANDIDATES)
VOTES = ("shape", "gazetteer", "context")


#: Powers of two, the steps of scans and of binary searches over an array.
_POWERS = [1 << i for i in range(30)]


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once."""
    return F.transform(F.array(value), of)[0]


def _scan(values: Column, join: Callable[[Column, Column], Column], none: Column) -> Column:
    """Running totals of an array by join, whose neutral value is none: spans double, so n values take n log n steps and nothing is appended."""

    def of(v):
        steps = F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < F.size(v))
        return F.aggregate(steps, v, lambda a, d: F.transform(a, lambda x, i: join(x, F.coalesce(F.get(a, i - d), none))))

    return _let(values, of)


def spans(text: Column, pattern: str) -> Column:
    """Array of (s, e, v, gap): leftmost non-overlapping matches, from the lengths of what lies between them; gap is the end of that, before the match."""

    def placed(pairs):
        ends = _scan(F.transform(pairs, lambda x: F.length(x["g"]) + F.length(x["v"])), lambda x, y: x + y, F.lit(0))
        return F.zip_with(ends, pairs, lambda e, x: F.struct((e - F.length(x["v"])).alias("s"), e.alias("e"), x["v"].alias("v"), F.right(x["g"], F.lit(CONTEXT)).alias("gap")))

    pairs = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, v: F.struct(g.alias("g"), v.alias("v"))))
    return F.when(text.rlike(pattern), _let(pairs, placed)).otherwise(F.array().cast("array<struct<s:int,e:int,v:string,gap:string>>"))


def _before(name: str, x: Column, i: Column) -> Column:
    """The CONTEXT characters before span x, the i-th of the array column name; no candidate has under five characters, so five pairs of gap and match hold them."""
    tail = F.concat(F.array_join(F.transform(F.slice(name, F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5))), lambda y: F.concat(y["gap"], y["v"])), ""), x["gap"])
    return F.right(F.when(F.length(x["gap"]) >= CONTEXT, x["gap"]).otherwise(tail), F.lit(CONTEXT))


def _clear(more: str, base: str) -> Column:
    """The spans of more that overlap none of base, which is sorted by start: the largest end among those that start before a span ends says it."""
    steps = F.array(*[F.lit(p) for p in reversed(_POWERS)])
    earlier = lambda e: F.aggregate(F.filter(steps, lambda p: p <= F.size(base)), F.lit(0), lambda n, p: n + F.when((n + p <= F.size(base)) & (F.get(F.col(base), n + p - 1)["s"] < e), p).otherwise(0))
    upto = _scan(F.transform(base, lambda b: b["e"]), lambda x, y: F.greatest(x, y), F.lit(0))
    return _let(upto, lambda u: F.filter(more, lambda x: F.coalesce(F.get(u, earlier(x["e"]) - 1) <= x["s"], F.lit(True))))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = F.sequence(F.lit(0), n - 1)
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(at, F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(F.substring(digits, n - i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, n - i, F.lit(1)).cast("int")))
    return total % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _passes(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda: F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False),
        "phone": lambda: (n >= 10) & (n <= 15),
    }[kind]()


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, more): base spans (s, k, e) and candidates with their votes and features."""
    t = texts(df, id_col, text_col)
    valid = lambda k: lambda x: _passes(k, x["v"])
    t = t.select("doc_id", "text", *[F.filter(spans(F.col("text"), p), valid(k)).alias(k) for k, p in PATTERNS.items()], *[spans(F.col("text"), p).alias(k) for k, p in CANDIDATES.items()])
    placed = lambda i: lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))
    vote = lambda c: F.when(c, 1).otherwise(0)

    def candidate(kind):
        def of(x, i):
            before = _before(kind, x, i)
            v = x["v"]
            return F.struct(
                x["s"].alias("s"), F.lit(ORDER.index(kind)).alias("k"), x["e"].alias("e"),
                vote(v.rlike(SHAPES[kind])).alias("shape"), vote(v.rlike(GAZETTEER[kind])).alias("gazetteer"), vote(before.rlike(CUES[kind])).alias("context"),
                F.least(F.floor(F.log2(x["e"] - x["s"] + 1)), F.lit(8)).cast("int").alias("size"),
                F.floor(4 * F.length(F.regexp_replace(v, "[^0-9]", "")) / F.length(v)).cast("int").alias("digits"),
            )

        return of

    base = F.array_sort(F.concat(*[F.transform(k, placed(i)) for i, k in enumerate(BASE)]))
    more = F.concat(*[F.transform(k, candidate(k)) for k in CANDIDATES])
    t = t.select("doc_id", base.alias("base"), more.alias("more"))
    return t.select("doc_id", "base", _clear("more", "base").alias("more"))


def reliabilities(counts: dict[tuple, float]) -> tuple[dict, dict]:
    """Dawid-Skene estimates from {(kind, votes...): count}: (parameters by kind, posterior by pattern)."""
    posterior = {p: 0.9 if sum(p[1:]) >= 2 else 0.1 for p in counts}
    model: dict = {}
    for _ in range(ROUNDS):
        model = {}
        for kind in {p[0] for p in counts}:
            own = [(p, n) for p, n in counts.items() if p[0] == kind]
            mass = [sum(n * (1 - posterior[p]) for p, n in own), sum(n * posterior[p] for p, n in own)]
            says = [[(SMOOTHING * (0.3 + 0.4 * y) + sum(n * (posterior[p] if y else 1 - posterior[p]) for p, n in own if p[1 + i])) / (SMOOTHING + mass[y]) for i in range(len(VOTES))] for y in (0, 1)]
            model[kind] = ((mass[1] + SMOOTHING) / (sum(mass) + 2 * SMOOTHING), says)
        for p in counts:
            prior, says = model[p[0]]
            odds = math.log(prior / (1 - prior)) + sum(math.log(says[1][i] / says[0][i]) if v else math.log((1 - says[1][i]) / (1 - says[0][i])) for i, v in enumerate(p[1:]))
            posterior[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return model, posterior


FEATURES = ("k", *VOTES, "size", "digits")


def classifier(found: DataFrame) -> Callable[[Column], Column] | None:
    """The trained span classifier: from a candidate to whether it is personal data; None without candidates."""
    rows = found.select(F.inline("more")).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as there are feature values, at most
    if not rows:
        return None
    patterns: dict[tuple, float] = {}
    for r in rows:
        p = (r.k, *(r[v] for v in VOTES))
        patterns[p] = patterns.get(p, 0) + r.n
    _, posterior = reliabilities(patterns)
    mass, tables = [0.0, 0.0], {f: {} for f in FEATURES}
    for r in rows:
        y = posterior[(r.k, *(r[v] for v in VOTES))]
        for c, part in ((0, 1 - y), (1, y)):
            mass[c] += r.n * part
            for f in FEATURES:
                tables[f].setdefault(r[f], [0.0, 0.0])[c] += r.n * part
    weight = {f: {v: math.log((n[1] + SMOOTHING) / (mass[1] + SMOOTHING * len(t))) - math.log((n[0] + SMOOTHING) / (mass[0] + SMOOTHING * len(t))) for v, n in t.items()} for f, t in tables.items()}
    bias = math.log((mass[1] + SMOOTHING) / (mass[0] + SMOOTHING))
    cut = math.log(MIN_POSTERIOR / (1 - MIN_POSTERIOR))

    def takes(x):
        at = lambda f: reduce(lambda c, kv: c.when(x[f] == kv[0], F.lit(kv[1])), list(weight[f].items())[1:], F.when(x[f] == next(iter(weight[f])), F.lit(next(iter(weight[f].values()))))).otherwise(F.lit(0.0))
        return reduce(lambda a, b: a + b, [at(f) for f in FEATURES], F.lit(bias)) > cut

    return takes


def _joined(c: str) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): every row's spans (s, k, e) by start, then kind (an index of ORDER), and base, the base spans alone."""
    docs = stored(find(df, id_col, text_col), "spans")
    takes = classifier(docs)
    plain = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    added = F.array().cast("array<struct<s:int,k:int,e:int>>") if takes is None else F.transform(F.filter("more", takes), plain)
    return docs.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    of_kind = lambda i: lambda x: x["k"] == i
    n = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *n, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"))
