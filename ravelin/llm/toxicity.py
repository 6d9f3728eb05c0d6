"""Toxicity by classifier chains over words and beginnings of words.

Categories are predicted in order, each by a linear (logistic) model over the presence of selected
words and the probabilities of all earlier categories. In training, those earlier probabilities are
out-of-fold predictions, so that a later model sees what it will see on new documents. The first two
categories are labelled by seed words among the toxic documents, the last one is the label itself.

Training takes at most MAX_LABELLED labelled rows (those of least hash of their id), one for each
text; words are selected by how unevenly they occur in the two classes. The sparse presence lists of
that bounded sample go to the driver; scoring is one pass over all whole texts.

Null texts are empty and not toxic unless the model says so of an empty text; null labels and labels
of unknown documents are left out. Without both classes in the labels, all probabilities are 0.
Repeated rows are scored each. Of equal texts with different labels, toxic holds. Other columns pass through score() unchanged unless it replaces them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import bounded_batches, stored, texts

MAX_LABELLED = 10_000
MAX_WORDS = 2_000
MIN_DOCUMENTS = 5
PREFIXES = (3, 4, 5)
FOLDS = 3
STEPS = 150
RIDGE = 1e-3
THRESHOLD = 0.5

# Seed words of the first two categories.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser", "fool", "dumb", "scum"),
    "contempt": ("worthless", "pathetic", "trash", "disgusting", "garbage", "hate", "useless", "filth"),
}
CATEGORIES = (*SEEDS, "toxic")

words_of = re.compile(r"[^\W\d_]+").findall


def presence(text: str) -> set[str]:
    """The words of a text, and with a caret their beginnings of PREFIXES letters, which inflected forms share."""
    words = set(words_of(text.lower()))
    return words | {"^" + w[:n] for w in words for n in PREFIXES if len(w) > n}


class Chain:
    """Words, and for each category the weights of words, earlier probabilities and bias."""

    def __init__(self, words: list[str], weights: list[np.ndarray]):
        self.words, self.weights = words, weights
        self.index = {w: i for i, w in enumerate(words)}

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """(rows, categories) for lists of word places."""
        out = np.zeros((len(rows), len(CATEGORIES)))
        if not self.weights or not rows:
            return out
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(n.sum()))
        of = np.repeat(np.arange(len(rows)), n)
        k = len(self.words)
        for c, w in enumerate(self.weights):
            z = np.bincount(of, w[flat], len(rows)) + out[:, :c] @ w[k : k + c] + w[-1]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def logistic(of: np.ndarray, flat: np.ndarray, extra: np.ndarray, y: np.ndarray, k: int, use: np.ndarray) -> np.ndarray:
    """Weights (words, extra columns, bias) of a ridge logistic regression over the rows in use (AdaGrad, full batch)."""
    m = extra.shape[1]
    w, g2 = np.zeros(k + m + 1), np.full(k + m + 1, 1e-8)
    on = use.astype(float)
    total = max(on.sum(), 1.0)
    balance = np.where(y > 0, 0.5 * total / max((on * y).sum(), 1.0), 0.5 * total / max((on * (1 - y)).sum(), 1.0)) * on
    rate = (on * y).sum() / total
    balance = balance * 0.5 + on * 0.5 if 0 < rate < 1 else on
    for _ in range(STEPS):
        z = np.bincount(of, w[flat], len(y)) + extra @ w[k : k + m] + w[-1]
        r = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
        g = np.concatenate([np.bincount(flat, r[of], k), r @ extra, [r.sum()]]) + RIDGE * np.append(w[:-1], 0.0) / 2
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """Fit the chain on the bounded sample of labelled documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    found = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id")  # MAX_LABELLED rows of two numbers
    # documents of one text are one example, toxic if any of them is labelled so
    sample = found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))

    def split(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(presence(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))], ["doc_id", "y", "words"])

    rows = stored(sample.select("doc_id", "y", "text").mapInArrow(split, "doc_id long, y int, words array<string>"), "labelled")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Chain([], [])
    df = rows.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCUMENTS)
    expected = F.col("n") * sizes[1] / sum(sizes.values())
    uneven = F.pow(F.col("p") - expected, 2) / expected
    words = [r.w for r in df.orderBy(F.desc(uneven), "w").limit(MAX_WORDS).collect()]
    place = {w: i for i, w in enumerate(words)}
    seeds = {c: set(s) for c, s in SEEDS.items()}
    wanted = sorted({*place, *(w for s in seeds.values() for w in s)})
    keep = F.array_intersect("words", F.lit(wanted))
    taken = rows.select("doc_id", "y", keep.alias("words")).orderBy("doc_id").collect()  # MAX_LABELLED rows at most
    found = [[place[w] for w in r.words if w in place] for r in taken]
    y = np.array([r.y for r in taken], float)
    targets = [np.array([float(r.y and not seeds[c].isdisjoint(r.words)) for r in taken]) for c in SEEDS] + [y]
    of = np.repeat(np.arange(len(found)), [len(f) for f in found])
    flat = np.fromiter((i for f in found for i in f), np.int64, len(of))
    fold = np.arange(len(found)) % FOLDS
    earlier = np.zeros((len(found), 0))
    weights = []
    for target in targets:
        weights.append(logistic(of, flat, earlier, target, len(words), np.ones(len(found), bool)))
        unseen = np.zeros(len(found))
        for f in range(FOLDS):
            w = logistic(of, flat, earlier, target, len(words), fold != f)
            z = np.bincount(of, w[flat], len(found)) + earlier @ w[len(words) : -1] + w[-1]
            unseen[fold == f] = (1 / (1 + np.exp(-np.clip(z, -40, 40))))[fold == f]
        earlier = np.column_stack([earlier, unseen])
    return Chain(words, weights)


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of df, then p_<category> (double) and is_toxic (boolean)."""
    bounded_batches(df.sparkSession)
    made = [*(f"p_{c}" for c in CATEGORIES), "is_toxic"]
    base = df.drop(*made)
    names = base.columns
    at = names.index(text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields] + [f"{m} double" for m in made[:-1]] + ["is_toxic boolean"])

    def run(batches):
        for batch in batches:
            index = chain.index
            rows = [[index[w] for w in presence(t) if w in index] if t else [] for t in batch.column(at).cast(pa.string()).to_pylist()]
            p = chain.probabilities(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in p.T), pa.array(p[:, -1] >= threshold if len(p) else [], pa.bool_())], [*names, *made])

    return base.mapInArrow(run, schema)
