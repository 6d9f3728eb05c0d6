"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Words are runs of Latin letters, A-Z in lower case, with one code point left out of some of them by
a hash (the misprints to be grouped). All words of a length, with those one shorter as queries, are sorted forwards
and backwards. The words with a given prefix are an interval of the first order, those with a given
suffix one of the second, and each word is a point of its two ranks. For every word and every place
of an edit, the points in the rectangle of the prefix before the place and the suffix after it are
the words that replace or insert one code point there; a wavelet tree over the second ranks in the
order of the first reports them. A deletion is an insertion seen from the other word.

Spark deals the words out by what an edit leaves: an edit in the back half leaves the front half,
and the other way round, so each word goes to two shards of its length and to two of the next, keyed
by that half. A key that too many words share is split: its range of places is halved and the
key grows by the characters of the other half, again until it is small. At one place a key has as many words as there
are letters at most, so no shard is unbounded. Each pair is found at exactly one place.

The words between a word and its root are followed by pointer jumping: the number of occurrences at
least doubles from form to form, so a few rounds do.

Null texts have no words; a null id hashes as an empty one. Rows that repeat an id or a text count each. Texts are
searched in pieces. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import bounded_batches, forget, stored, texts

MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: One run in so many (by its hash) loses a code point.
EVERY = 97
#: Code points of text searched at a time, distinct words counted at a time, and rows from which a key is split.
PIECE, HELD, KEY_ROWS = 1 << 20, 100_000, 20_000
#: Rectangles searched at a time.
QUERIES = 1 << 18

LETTERS = re.compile(rb"[a-z\xC0-\xFF]+")


def _pieces(text: str) -> Iterator[bytes]:
    """A text in Latin-1, all else as question marks, A-Z in lower case, cut between runs of letters."""
    raw, a = memoryview(text.encode("latin-1", "replace").lower()), 0
    while len(raw) - a > PIECE:
        b = a + PIECE
        while b < len(raw) and LETTERS.match(raw, b - 1, b) and LETTERS.match(raw, b, b + 1):
            b += 1
        yield bytes(raw[a:b])
        a = b
    yield bytes(raw[a:])


def counted(text: str, seed: int, long_enough: re.Pattern, into: Counter, every: int, min_chars: int) -> None:
    """Add a text's words to a counter; seed is the CRC-32 of what goes before a run."""
    for piece in _pieces(text):
        for run, k in Counter(long_enough.findall(piece)).items():
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < min_chars:
                    continue
            into[run] += k


def words(df: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): distinct words in Latin-1, with their numbers of occurrences. A task sums up what it reads before it is shuffled."""
    bounded_batches(df.sparkSession, rows=500, mb=16)

    def run(batches):
        found: Counter = Counter()
        long_enough = re.compile(rb"[a-z\xC0-\xFF]{%d,}" % min_chars)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                counted(t.as_py(), zlib.crc32(f"{'' if i is None else i}:".encode()), long_enough, found, every, min_chars)
                if len(found) > HELD:
                    yield out(found)
                    found.clear()
        yield out(found)

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])

    parts = texts(df, id_col, text_col).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Wavelet:
    """A wavelet tree over the numbers 0 to len(values) - 1, each once: which places hold a number of a range."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, (len(values) - 1).bit_length())
        self.ones, self.cuts, now = [], [], values.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            one = (now >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one)]))
            self.cuts.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[one == 0], now[one == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [low, high) that stand at places [left, right), of many queries at once."""
        query = np.arange(len(left))
        base = np.zeros(len(left), np.int64)  # the least value below a node
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, cut, half = self.ones[level], self.cuts[level], 1 << b
            to_left, to_right = ones[left], ones[right]
            down, up = (left - to_left, right - to_right, base), (cut + to_left, cut + to_right, base + half)
            parts = []
            for x, y, z in (down, up):
                on = np.flatnonzero((x < y) & (z < high[query]) & (z + half > low[query]))
                parts.append((x[on], y[on], z[on], query[on]))
            left, right, base, query = (np.concatenate(x) for x in zip(*parts))
        return query, base


def _order(chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of characters (zeros behind their ends), and how many characters each has in common with the one before."""
    order = np.argsort(np.ascontiguousarray(chars).view(f"S{chars.shape[1]}").ravel(), kind="stable")
    rows, n = chars[order], size[order]
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), chars.shape[1])
    return order, np.concatenate([[0], np.minimum(same, np.minimum(n[1:], n[:-1]))]).astype(np.int64)


def near(chars: np.ndarray, size: np.ndarray, places: range) -> tuple[np.ndarray, np.ndarray]:
    """(query, target): all rows of the greatest length L that a row of length L or L - 1 becomes by one replaced or inserted character at one of the places.

    chars holds each word once, with zeros behind its end.
    """
    width = chars.shape[1]
    none = np.empty(0, np.int64)
    if len(chars) < 2:
        return none, none
    back = np.zeros_like(chars)
    for n in (width - 1, width):
        back[size == n, :n] = chars[size == n, :n][:, ::-1]
    target = size == width
    fore_order, fore_same = _order(chars, size)
    back_order, back_same = _order(back, size)
    before = lambda order: np.concatenate([[0], np.cumsum(target[order])])  # noqa: E731  targets in front of each rank
    fore_before, back_before = before(fore_order), before(back_order)
    targets = fore_order[target[fore_order]]
    if not len(targets):
        return none, none
    rank = np.empty(len(chars), np.int64)
    rank[back_order] = np.arange(len(chars))
    tree = Wavelet(back_before[rank[targets]])
    by_back = back_order[target[back_order]]

    def interval(order, same, ahead, k):
        """For each row, the targets whose first k characters are the row's, as an interval of the order."""
        first = np.flatnonzero(same < k) if k else np.zeros(1, np.int64)
        group = np.cumsum(same < k) - 1 if k else np.zeros(len(same), np.int64)
        a, b = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        a[order], b[order] = ahead[first][group], ahead[np.append(first[1:], len(order))][group]
        return a, b

    out = []
    for i in places:
        a, b = interval(fore_order, fore_same, fore_before, i)
        c, d = interval(back_order, back_same, back_before, width - i - 1)
        # a replaced word is itself in its rectangle
        ask = np.flatnonzero((b - a > target) & (d - c > target))
        for k in range(0, len(ask), QUERIES):
            q = ask[k : k + QUERIES]
            found, value = tree.report(a[q], b[q], c[q], d[q])
            x, y = q[found], by_back[value]
            # an insertion into a run of one character counts at the last of its places
            on = (x != y) & (target[x] | (i == width - 1) | (chars[x, i] != chars[y, i]))
            out.append((x[on], y[on]))
    return tuple(np.concatenate([none, *x]) for x in zip(*out)) if out else (none, none)


def dealt(vocabulary: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """(key, length, first, last, word, n): each word as target and query of its length and as query of the next, for edits at places first to last - 1."""
    place = F.expr("inline(array(named_struct('length', size, 'first', 0, 'last', size div 2), named_struct('length', size, 'first', size div 2, 'last', size), named_struct('length', size + 1, 'first', 0, 'last', (size + 1) div 2), named_struct('length', size + 1, 'first', (size + 1) div 2, 'last', size + 1)))")
    rows = vocabulary.withColumn("size", F.octet_length("word")).select("word", "n", place)
    key = F.xxhash64("length", "first", "last", F.expr("substr(word, 1, first)"), F.expr("substr(word, octet_length(word) - length + last + 1, length - last)"))
    now = rows.withColumn("key", key)
    done = None
    while True:
        heavy = stored(now.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("last") - F.col("first")).alias("places")).where((F.col("rows") > key_rows) & (F.col("places") > 1)).select("key"), "heavy")
        if heavy.isEmpty():
            return now if done is None else done.unionByName(now)
        now = stored(now, "dealt")
        small = now.join(heavy, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        halves = F.expr("inline(array(named_struct('first', first, 'last', (first + last) div 2), named_struct('first', (first + last) div 2, 'last', last)))")
        now = now.join(heavy, "key", "left_semi").select("word", "n", "length", halves).withColumn("key", key)


def pairs(vocabulary: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """(word, n, other, other_n) of all near words of vocabulary(word, n), in both directions."""
    bounded_batches(vocabulary.sparkSession, rows=10_000, mb=16)

    def run(batches):
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            kind = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((kind[1:] != kind[:-1]).any(axis=1)) + 1).tolist(), len(kind)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at is not None and at != tuple(kind[a]):
                    yield from found(at, held)
                    held = []
                at = tuple(kind[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from found(at, held)

    def found(at, held):
        length, first, last = map(int, at)
        t = pa.Table.from_batches(held)
        word, n = t.column(3).to_numpy(zero_copy_only=False), t.column(4).to_numpy()
        chars = np.array(word.tolist(), dtype=f"S{length}").view(np.uint8).reshape(-1, length)
        x, y = near(chars, np.fromiter(map(len, word), np.int64, len(word)), range(first, last))
        shorter = np.fromiter(map(len, word[x]), np.int64, len(x)) < length
        x, y = np.concatenate([x, y[shorter]]), np.concatenate([y, x[shorter]])
        for k in range(0, len(x), 20_000):
            p, q = x[k : k + 20_000], y[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(word[p], pa.binary()), pa.array(n[p]), pa.array(word[q], pa.binary()), pa.array(n[q])], ["word", "n", "other", "other_n"])

    shards = dealt(vocabulary, key_rows).select("length", "first", "last", "word", "n", "key").repartition("key").sortWithinPartitions("length", "first", "last")
    return shards.select("length", "first", "last", "word", "n").mapInArrow(run, "word binary, n long, other binary, other_n long")


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of forms(word, form): the last form that is followed from each word. A round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("there")), "roots")
    for _ in range(rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("then"))
        step = now.where("not there").join(ahead, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNull().alias("there"))
        now, before = stored(now.where("there").unionByName(step), "roots"), now
        forget(forms.sparkSession, before)
        if now.where("not there").isEmpty():
            return now.select("word", "root")
    raise RuntimeError(f"roots did not settle in {rounds} rounds")


def group(df: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY, ratio: int = RATIO, key_rows: int = KEY_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word.

    n_near is its number of near words; form the most frequent of them (of equals the least) if it is
    ratio times as frequent as the word or more, else null; root the last form followed from the word.
    """
    vocabulary = stored(words(df, min_chars, min_count, every, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    around = pairs(vocabulary, key_rows).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), best)
    formed = -F.col("best.n") >= ratio * F.col("n")
    around = stored(around.select("word", "n_near", F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n")), "near")
    ends = roots(around.where("form is not null").select("word", "form"))
    text = lambda c: F.decode(c, "ISO-8859-1")
    out = vocabulary.join(around, "word", "left").join(ends, "word", "left")
    return out.select(text("word").alias("word"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), text("form").alias("form"), "form_n", text(F.coalesce("root", "word")).alias("root"))
