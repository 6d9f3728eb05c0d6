"""Fill-in-the-middle transformation over ropes.

A text is a rope: a balanced tree of short pieces whose nodes cache how many units (lines) end below
them and how many code points lie there. Splitting it at two unit ranks gives prefix, middle and
suffix, which are joined again in the order of the form with sentinels between. The inverse builds a
rope of the output, splits it by code points at the sentinels and joins the parts in their first
order. Split and join touch a path of the tree, so a text of any length is copied only when it is
written out. Every document is worked on alone: no shuffle, and a lost task is done again.

The form and the cuts come from the SHA-256 of seed and doc_id, so they do not depend on partitions
or on the run. Null texts are empty; empty texts and texts that hold a sentinel stay plain. A null id
hashes as an empty one. Rows that repeat an id are cut by the same numbers, each its own text. Other
columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import bounded_batches, texts

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Percent of the texts that are transformed, and of these the percent in the form spm.
RATE, SPM_RATE = 100, 50
#: Code points of a leaf.
LEAF = 4096

TYPES = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string", "restored": "string", "output_sha256": "string", "restored_sha256": "string"}


class Rope:
    """A leaf (text) or an inner node (left, right); units is the number of line ends below, chars that of code points."""

    __slots__ = ("chars", "left", "right", "text", "units")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.units, self.chars = text.count("\n"), len(text)
        else:
            self.units, self.chars = left.units + right.units, left.chars + right.chars


def rope(text: str, leaf: int = LEAF) -> Rope:
    """A balanced rope of a text."""
    level = [Rope(text[a : a + leaf]) for a in range(0, max(len(text), 1), leaf)]
    while len(level) > 1:
        level = [joined(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def joined(*parts: Rope) -> Rope:
    """The parts one after another."""
    out = parts[0]
    for x in parts[1:]:
        out = x if not out.chars else out if not x.chars else Rope(left=out, right=x)
    return out


def _cut(x: Rope, k: int, by: str) -> tuple[Rope, Rope]:
    """x before and after its first k > 0 units or code points, of which it has more than k or just k."""
    if x.left is None:
        if by == "chars":
            return Rope(x.text[:k]), Rope(x.text[k:])
        at = -1
        for _ in range(k):
            at = x.text.index("\n", at + 1)
        return Rope(x.text[: at + 1]), Rope(x.text[at + 1 :])
    have = getattr(x.left, by)
    if k <= have:
        a, b = _cut(x.left, k, by)
        return a, joined(b, x.right)
    a, b = _cut(x.right, k - have, by)
    return joined(x.left, a), b


def split(x: Rope, k: int, by: str) -> tuple[Rope, Rope]:
    """x before and after its first k units (by "units") or code points ("chars"); all of it comes first if it has fewer."""
    if k <= 0:
        return Rope(), x
    return (x, Rope()) if k > getattr(x, by) else _cut(x, k, by)


def written(x: Rope) -> str:
    """The text of a rope."""
    out, todo = [], [x]
    while todo:
        x = todo.pop()
        if x.left is None:
            out.append(x.text)
        else:
            todo += [x.right, x.left]
    return "".join(out)


def transformed(text: str, numbers: tuple[int, ...], rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of a text; numbers: two for the cuts, one for whether, one for the form."""
    whole = rope(text)
    n = whole.units + (bool(text) and text[-1] != "\n")
    if not text or any(s in text for s in sentinels) or numbers[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted(h % (n + 1) for h in numbers[:2])
    head, suffix = split(whole, last, "units")
    prefix, middle = split(head, first, "units")
    p, s, m = map(Rope, sentinels)
    form = "spm" if numbers[3] % 100 < spm_rate else "psm"
    out = joined(s, suffix, p, prefix, m, middle) if form == "spm" else joined(p, prefix, s, suffix, m, middle)
    return n, form, prefix.chars, middle.chars, written(out)


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text of an output: no part holds a sentinel, so the first place of each is its own."""
    if form == "plain":
        return output
    p, s, m = sentinels
    one, two = (s, p) if form == "spm" else (p, s)
    at_two = output.index(two, len(one))
    at_three = output.index(m, at_two + len(two))
    _, rest = split(rope(output), len(one), "chars")
    a, rest = split(rest, at_two - len(one), "chars")
    _, rest = split(rest, len(two), "chars")
    b, rest = split(rest, at_three - at_two - len(two), "chars")
    _, middle = split(rest, len(m), "chars")
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return written(joined(prefix, middle, suffix))


def numbers(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """The first four 32-bit numbers of the SHA-256 of `seed:doc_id`."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def apply(df: DataFrame, columns: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"), seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns asked for (of TYPES) of every row; restored is worked out from output and form alone."""
    if len(set(sentinels)) < 3 or any(a in b for a in sentinels for b in sentinels if a != b) or any(a[:k] == b[-k:] for a in sentinels for b in sentinels for k in range(1, min(len(a), len(b)))):
        raise ValueError("sentinels must not be part of one another, nor begin as one of them ends")
    bounded_batches(df.sparkSession, rows=500, mb=16)

    def run(batches):
        for batch in batches:
            made: dict[str, list] = {c: [] for c in columns}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), transformed(t.as_py(), numbers(seed, i), rate, spm_rate, sentinels)))
                if "restored" in made or "restored_sha256" in made:
                    out["restored"] = restored(out["output"], out["form"], sentinels)
                for c in columns:
                    made[c].append(_sha(out[c.removesuffix("_sha256")]) if c.endswith("_sha256") else out[c])
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[c], kinds[TYPES[c]]) for c in columns)], ["doc_id", *columns])

    return texts(df, id_col, text_col).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {TYPES[c]}" for c in columns)]))


def restore(df: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", output_col: str = "output", form_col: str = "form") -> DataFrame:
    """(doc_id, text) of outputs and their forms; a null form is plain, a null output empty."""
    bounded_batches(df.sparkSession, rows=500, mb=16)

    def run(batches):
        for batch in batches:
            found = [restored(t.as_py(), f, sentinels) for t, f in zip(batch.column(1), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return texts(df, id_col, output_col, keep=(F.coalesce(F.col(form_col), F.lit("plain")).alias("form"),)).mapInArrow(run, "doc_id long, text string")
