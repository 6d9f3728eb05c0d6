"""MinHash near-duplicate detection with odd sketches.

SAMPLES MinHash values of a document's set of word shingles make BANDS keys of ROWS values each. The
values are also folded into an odd sketch: a bitmap with a bit flipped for each value, so the exclusive or of two
bitmaps has a bit for what the documents do not share and its population count estimates a high similarity
precisely. Documents that share a key are candidates if their set sizes allow it and their sketches are
close enough; candidates are then compared by their full sets.

1. Equal sets are one class, whose smallest id stands for it.
2. A key that several classes share names its smallest one; all classes that meet under the same smallest one
   are a crowd. Crowds are dealt into blocks of bounded size, the smallest one in each; within a
   block every candidate pair is compared unless compared pairs connect it already.
3. Where a crowd of several blocks has not become one component by then, its largest component and
   the rest are dealt anew, and each block of the rest meets every block of both.

In both steps sketches go first, and only those with a candidate are joined with their sets. So a
group of copies or near copies of any size costs its members times a few, without all its pairs and
without a task that holds all of it. A crowd of many documents just below the threshold is quadratic by nature; its work is
dealt out by pairs of blocks.

A pair just at the threshold shares no key with probability (1 - 0.8 ** ROWS) ** BANDS, about 1 in 8 million;
closer pairs are surer. The sketches' limit lies five deviations beyond the mean of such a pair.

Null texts, and texts without words, have an empty set and are linked with nothing; with fewer words
than a shingle, the whole word sequence is the one shingle. Rows that repeat an id are one document
with several sets. Rows without an id join the component of an equal set but lend no links; alone, their
component is null. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import bounded_batches, stored, texts
from ravelin.llm.graph import components
from ravelin.llm.simhash import mixed, shingle_hashes

WORDS = 4
#: Documents are linked from a share of shared shingles of NUMBER in OF.
NUMBER, OF = 80, 100
ROWS, BANDS = 5, 40
SAMPLES = ROWS * BANDS
#: Bits of an odd sketch.
BITS = 1024
#: Documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000
#: Shingles whose values are worked out at a time, and sets that are compared with one at a time.
STEP, SETS = 1024, 256

_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def samples(h: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of hashes: the least of each of SAMPLES multiples."""
    least = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(h), STEP):
        np.minimum(least, (_FACTORS[:, None] * h[None, a : a + STEP]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of values."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ column, 1)
    return key.view(np.int64)


def odd_sketch(least: np.ndarray) -> bytes:
    """The bitmap in which each value has flipped a bit."""
    at = mixed(least + np.arange(len(least), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2) >> np.uint64(64 - (BITS - 1).bit_length())
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def odd_limit(similarity: float, deviations: float = 5) -> int:
    """Bits in which the sketches of two sets of this similarity or more differ at most, but for so many standard deviations."""
    differ = 2 * SAMPLES * (1 - similarity)  # values of one document only, two for each sample that differs
    keep = np.exp(-2 * differ / BITS)
    odd = (1 - keep) / 2  # the chance of a bit
    spread = np.sqrt(BITS * odd * (1 - odd) + (2 * keep) ** 2 * SAMPLES * similarity * (1 - similarity))
    return int(np.ceil(BITS * odd + deviations * spread))


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text, words))


def _digest(h: np.ndarray) -> np.ndarray:
    import xxhash

    return np.frombuffer(xxhash.xxh128_digest(h.tobytes()), np.int64)


def signatures(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, n, bands, odd) of every row: digest and size of its set, keys of its bands, odd sketch; none for empty sets."""
    bounded_batches(df.sparkSession, rows=500, mb=16)

    def run(batches):
        for batch in batches:
            keys, n, bands, odd = [], [], [], []
            for t in batch.column(1):
                h = shingles(t.as_py(), words)
                least = samples(h)
                keys.append(_digest(h))
                n.append(len(h))
                bands.append(band_keys(least) if len(h) else None)
                odd.append(odd_sketch(least) if len(h) else None)
            k = np.concatenate([np.empty(0, np.int64), *keys]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.binary())], ["id", "k1", "k2", "n", "bands", "odd"])

    return texts(df, id_col, text_col).mapInArrow(run, "id long, k1 long, k2 long, n long, bands array<long>, odd binary")


def crowds(reps: DataFrame) -> DataFrame:
    """(label, id, k1, n, odd) of all classes reps(id, k1, n, bands, odd) that share a key, under the least id of each key."""
    rows = reps.select("id", "k1", F.explode("bands").alias("key"))
    shared = stored(rows.groupBy("key").agg(F.min("id").alias("label"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "label"), "shared")
    return rows.join(shared, "key").select("label", "id", "k1").distinct().join(reps.select("id", "k1", "n", "odd"), ["id", "k1"])


def blocks(n: str = "rows", shingles: str = "shingles"):
    """Into how many blocks so many documents with so many shingles go."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_DOCS), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def runs(batches: Iterator[pa.RecordBatch], by: int = 3) -> Iterator[pa.Table]:
    """The rows of sorted batches that are equal in their first columns, together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        kind = np.stack([batch.column(i).to_numpy() for i in range(by)], axis=1)
        cuts = [0, *(np.flatnonzero((kind[1:] != kind[:-1]).any(axis=1)) + 1).tolist(), len(kind)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and any(held[0].column(i)[0].as_py() != kind[a, i] for i in range(by)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """Documents of a block, or of the two sides of a pair of blocks, and which of them are candidates of each other."""

    def __init__(self, t: pa.Table, number: int, of: int, limit: int):
        self.table, self.number, self.of, self.limit = t, number, of, limit
        self.id, self.n, self.comp = (t.column(c).to_numpy() for c in ("id", "n", "comp"))
        self.odd = np.frombuffer(b"".join(t.column("odd").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        self.side = None if t.column("i")[0] == t.column("j")[0] else t.column("side").to_numpy()

    def near(self, x: int, rest: np.ndarray) -> np.ndarray:
        """Those rows of rest that may be linked with row x."""
        if self.side is not None:
            rest = rest[self.side[rest] != self.side[x]]
        n = self.n[rest]
        rest = rest[self.of * np.minimum(n, self.n[x]) >= self.number * np.maximum(n, self.n[x])]
        return rest[np.bitwise_count(self.odd[rest] ^ self.odd[x]).sum(axis=1, dtype=np.int64) <= self.limit]

    def pruned(self) -> pa.Table:
        """The rows that have a candidate in another component."""
        keep, every = np.zeros(len(self.id), bool), np.arange(len(self.id))
        for x in range(len(every) - 1):
            ahead = every[x + 1 :]
            near = self.near(x, ahead[self.comp[ahead] != self.comp[x]])
            keep[near] = True
            keep[x] |= bool(len(near))
        return self.table.filter(pa.array(keep))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect all pairs of candidates whose sets are alike; a component is reached only over a pair that was compared."""
        sets = [np.frombuffer(s, np.uint64) for s in self.table.column("s").to_pylist()]
        ends = np.cumsum(self.n)
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.zeros(len(names), bool)
        rest = np.arange(len(self.id))
        left, right = [], []
        while len(rest):
            first = self.comp[rest] == self.comp[rest[0]]
            queue, rest = rest[first].tolist(), rest[~first]
            while queue and len(rest):
                x = queue.pop()
                near = self.near(x, rest)
                if not len(near):
                    continue
                mine = flat[ends[x] - self.n[x] : ends[x]]
                own[mine] = True
                hit = []
                for k in range(0, len(near), SETS):
                    part = near[k : k + SETS]
                    upto = np.cumsum(self.n[part])
                    where = np.arange(upto[-1]) + np.repeat(ends[part] - upto, self.n[part])
                    both = np.add.reduceat(own[flat[where]], upto - self.n[part], dtype=np.int64)
                    hit.append(part[self.of * both >= self.number * (self.n[x] + self.n[part] - both)])
                own[mine] = False
                hit = np.concatenate(hit)
                if len(hit):
                    one = np.unique(self.comp[hit], return_index=True)[1]
                    left.append(np.full(len(one), self.id[x]))
                    right.append(self.id[hit[one]])
                    met = np.isin(self.comp[rest], self.comp[hit])
                    queue += rest[met].tolist()
                    rest = rest[~met]
        none = np.empty(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])


def linked(members: DataFrame, sets, number: int, of: int) -> DataFrame:
    """Links (a, b) within each block (label, i, j) of members(label, i, j, side, comp, id, k1, n, odd); sets(ids) gives (id, k1, s)."""
    limit = odd_limit(number / of)
    kind = "label long, i int, j int, side int, comp long, id long, k1 long, n long, odd binary"
    names = [x.split()[0] for x in kind.split(", ")]

    def prune(batches):
        for t in runs(batches):
            yield from Block(t, number, of, limit).pruned().to_batches()

    def compare(batches):
        for t in runs(batches):
            a, b = Block(t, number, of, limit).links()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    by_block = lambda df: df.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "id", "k1")
    left = stored(by_block(members.select(*names)).mapInArrow(prune, kind), "candidates")
    if left.isEmpty():
        return left.select(F.col("id").alias("a"), F.col("id").alias("b"))
    full = left.join(sets(left.select("id").distinct()), ["id", "k1"]).select(*names, "s")
    return stored(by_block(full).mapInArrow(compare, "a long, b long"), "links")


def cross(big: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of blocks in which the crowds big(label, id, k1, n, odd) that are of several components meet, as members for linked().

    The largest component of a crowd goes to blocks of its own, in front; the rest to others, which
    meet themselves and all blocks in front of them.
    """
    comp = F.coalesce("root", "id").alias("comp")
    rows = stored(big.join(roots.withColumnRenamed("node", "id"), "id", "left").select("label", "id", "k1", "n", "odd", comp), "crowds")
    parts = rows.groupBy("label", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    most = F.max(F.struct("rows", "comp", "shingles"))
    of = parts.groupBy("label").agg(F.count(F.lit(1)).alias("parts"), most.alias("most"), F.sum("rows").alias("all_rows"), F.sum("shingles").alias("all_shingles")).where("parts > 1")
    of = of.select("label", F.col("most.comp").alias("giant"), F.col("most.rows").alias("rows"), F.col("most.shingles").alias("shingles"), (F.col("all_rows") - F.col("most.rows")).alias("others"), (F.col("all_shingles") - F.col("most.shingles")).alias("other_shingles"))
    of = of.select("label", "giant", blocks().alias("front"), blocks("others", "other_shingles").alias("back"))
    h = F.xxhash64("id", "k1")
    own = F.when(F.col("comp") == F.col("giant"), F.pmod(h, "front")).otherwise(F.col("front") + F.pmod(h, "back")).cast("int")
    put = rows.join(of, "label").withColumn("own", own)
    last = F.col("front") + F.col("back") - 1
    before = F.when(F.col("own") >= F.col("front"), F.transform(F.sequence(F.lit(0), F.col("own")), lambda x: F.struct(x.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))).otherwise(F.array())
    behind = F.transform(F.filter(F.sequence("front", last), lambda x: x > F.col("own")), lambda x: F.struct(F.col("own").alias("i"), x.cast("int").alias("j"), F.lit(0).alias("side")))
    return put.select("label", F.inline(F.concat(before, behind)), "comp", "id", "k1", "n", "odd")


def links(df: DataFrame, reps: DataFrame, words: int = WORDS, number: int = NUMBER, of: int = OF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) that connect all classes reps(id, k1, n, bands, odd) whose sets share number in of or more of their union."""

    def run(batches):
        for batch in batches:
            found = [shingles(t.as_py(), words) for t in batch.column(1)]
            k1 = [int(_digest(h)[0]) for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1, pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], ["id", "k1", "s"])

    found = stored(crowds(reps), "crowds")
    sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).select("label", blocks().alias("blocks"))
    several = stored(found.join(sizes, "label"), "sized")
    big = several.where("blocks > 1").drop("blocks")
    known: list[DataFrame] = []

    def sets(ids: DataFrame) -> DataFrame:
        """The sets of these documents and of all in crowds of several blocks, which are all that the second step can ask for: texts are read once."""
        if not known:
            wanted = ids.union(big.select("id")).distinct().withColumnRenamed("id", "doc_id")
            rows = texts(df, id_col, text_col).join(wanted.hint("merge"), "doc_id", "left_semi")  # texts are dealt out by id, at any size
            known.append(stored(rows.mapInArrow(run, "id long, k1 long, s binary").dropDuplicates(["id", "k1"]), "sets"))
        return known[0]

    here = F.when(F.col("id") == F.col("label"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "k1"), "blocks").cast("int")))
    dealt = several.select("label", "id", "k1", "n", "odd", F.explode(here).alias("i"))
    first = linked(dealt.select("label", "i", F.col("i").alias("j"), F.lit(0).alias("side"), F.col("id").alias("comp"), "id", "k1", "n", "odd"), sets, number, of)
    if big.isEmpty():
        return first
    return first.unionByName(linked(cross(big, components(first)), sets, number, of))


def groups(df: DataFrame, words: int = WORDS, number: int = NUMBER, of: int = OF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: the size of its set, the least id reachable over links, and whether that is its own."""
    found = stored(signatures(df, words, id_col, text_col), "signatures")
    one = found.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    classes = stored(one, "classes")
    rows = found.select("id", "k1", "k2", "n").join(classes.where("n > 0").select("k1", "k2", F.col("id").alias("rep")), ["k1", "k2"], "left")
    named = stored(rows.select("id", "n", F.coalesce("rep", "id").alias("rep")), "named")
    # a document of several sets connects their classes
    least = named.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("id", "a")
    again = named.join(least, "id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()
    reps = classes.where("n > 0 and id is not null").select("id", "k1", "n", "bands", "odd")
    roots = components(links(df, reps, words, number, of, id_col, text_col).unionByName(again))
    out = named.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
