"""SimHash near-duplicate detection with pigeonring filtering.

A fingerprint is dealt into a ring of consecutive segments. If two fingerprints differ in at most t
bits, then from some segment on every chain of 1, 2, ... consecutive segments differs in at most its
proportional share of t, rounded down. With more segments than t that first segment is equal, so it
is the key of an equi-join, for many fingerprints together with the next, which differs in one bit at
most; the longer chains prune what meets there before the full Hamming check.

Only distinct fingerprints are joined. A segment value that many of them share is searched from link
to link over those not yet reached, so it gives as many links as it has members at most and the
connected components stay whole.

Null texts count as empty. Texts without words have fingerprint zero, linked like any other; with
fewer words than a shingle, the whole word sequence is the one shingle. Equal texts and repeated rows
share a fingerprint and a component. A null id takes part but is never the smallest. Empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import bounded_batches, stored, texts
from ravelin.llm.graph import components

SEED = 42
SEGMENTS = 4
MAX_DIFF = 3
#: Distinct fingerprints from which keys are of two segments, so that few others share one.
MANY = 1 << 22
#: Shingles whose bits are counted at a time.
BLOCK = 60_000
#: Rows of equal key that are compared pairwise without a search.
SMALL_RUN = 32

_SPREAD = np.array([sum(((x >> j) & 1) << (8 * j) for j in range(8)) for x in range(256)], dtype=np.uint64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    import xxhash

    split = text.encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.empty(0, np.uint64)
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    size = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words or None].tolist(), ends[words - 1 :].tolist())], dtype=np.uint64)


def mixed(h: np.ndarray, r: int) -> np.ndarray:
    """The r-th 64 bits derived from 64-bit hashes; r = 0 gives the hashes themselves."""
    if r == 0:
        return h
    z = h + np.uint64((r * 0x9E3779B97F4A7C15) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set: eight counters of a byte ride in one addition."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(h), 255 * 256):
        rows = _SPREAD[h[a : a + 255 * 256].view(np.uint8).reshape(-1, 8)]
        for b in range(0, len(rows), 255):
            total += rows[b : b + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprint(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """width 64-bit words of majority bits; zeros without hashes."""
    out = np.zeros(width, np.uint64)
    for r in range(width if len(hashes) else 0):
        out[r] = np.packbits(2 * bit_counts(mixed(hashes, r)) > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every row's word shingles, as a signed long."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, words))[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def chain_mask(x: np.ndarray, first: np.ndarray | int, max_diff: int, segments: int) -> np.ndarray:
    """Which differences x keep every chain from segment first on within its share of max_diff."""
    width = 64 // segments
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for k in range(segments):
        at = ((first + k) % segments * width).astype(np.uint64) if isinstance(first, np.ndarray) else np.uint64((first + k) % segments * width)
        total += np.bitwise_count((x >> at) & np.uint64((1 << width) - 1))
        ok &= total <= (k + 1) * max_diff // segments
    return ok


def _run_links(key: np.ndarray, fp: np.ndarray, max_diff: int, segments: int, shift: int):
    """Links among rows of equal key (sorted): all in small runs, a spanning forest in large ones. A key's first segment is what is above shift bits."""
    left, right = [], []
    edge = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    big = ends - starts > SMALL_RUN
    small = np.repeat(~big, ends - starts)
    k, f = key[small], fp[small]
    for s in range(1, SMALL_RUN):
        i = np.flatnonzero(k[s:] == k[:-s]) if s < len(k) else np.empty(0, np.int64)
        if not len(i):
            break
        i = i[chain_mask(f[i] ^ f[i + s], k[i] >> shift, max_diff, segments)]
        left.append(f[i])
        right.append(f[i + s])
    for a, b in zip(starts[big].tolist(), ends[big].tolist()):
        rest, first = fp[a:b], int(key[a]) >> shift
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                hit = chain_mask(rest ^ at, first, max_diff, segments)
                if hit.any():
                    found, rest = rest[hit], rest[~hit]
                    queue += list(found)
                    left.append(np.full(len(found), at, np.uint64))
                    right.append(found)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(fps: DataFrame, max_diff: int = MAX_DIFF, segments: int = SEGMENTS, chain: int = 1) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of fps(fp) within max_diff bits of each other.

    chain is the number of segments in a key, one or two. The second segment of the right chain differs in one bit at
    most, so with two every fingerprint is also dealt to the keys that have one bit more set there:
    about nine times the rows, for keys as many as the square.
    """
    if not 0 <= max_diff < segments or 64 % segments or 64 // segments > 16:
        raise ValueError("there must be more segments than bits that may differ, of 16 bits at most")
    if chain not in (1, 2) or 2 * max_diff // segments > 1:
        raise ValueError("a chain of one or two segments, whose second differs in one bit at most")
    width = 64 // segments
    shift = chain * width
    part = lambda i: F.shiftright(F.col("fp"), i % segments * width).bitwiseAND(F.lit((1 << width) - 1))
    if chain == 1:
        keys = F.array([part(i) + F.lit(i << shift) for i in range(segments)])
    else:
        own = [F.shiftleft(part(i), width) + part(i + 1) + F.lit(i << shift) for i in range(segments)]
        more = [F.when(part(i + 1).bitwiseAND(F.lit(1 << b)) == 0, k + F.lit(1 << b)) for i, k in enumerate(own) for b in range(width)]
        keys = F.array_compact(F.array([*own, *more]))
    keyed = fps.select("fp", F.explode(keys).alias("key"))

    def run(batches):
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)])
            fp = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            held_k, held_f = key[cut:], fp[cut:]
            if cut:
                yield out(_run_links(key[:cut], fp[:cut], max_diff, segments, shift))
        if len(held_k):
            yield out(_run_links(held_k, held_f, max_diff, segments, shift))

    def out(pair):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in pair], ["a", "b"])

    return keyed.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def groups(df: DataFrame, words: int = 3, max_diff: int = MAX_DIFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id linked to the row, its own included."""
    docs = stored(fingerprints(df, words, id_col, text_col), "fingerprints")
    distinct = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), max_diff, chain=1 if distinct.count() <= MANY else 2))
    of = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(of, "roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# ---- near-duplicates by shingle similarity --------------------------------------------------------

#: Words of a shingle, similarity from which two texts are near-duplicates, 64-bit words of the wide fingerprint.
SHINGLE, SIMILARITY, WIDTH = 5, 0.8, 13
#: Bits of the wide fingerprint's first 128 that may differ in a candidate pair, about five deviations
#: above the mean at SIMILARITY, and the segments of its ring.
CHECK_DIFF, CHECK_SEGMENTS = 38, 8
#: Candidate pairs of a run that are sent as such; more are sent as a crowd.
FEW = 2
#: Sets of shingles that are compared with one at a time.
BLOCK_ROWS = 256


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n, code): digest of the word sequence, number of distinct shingles, wide fingerprint."""
    import xxhash

    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            keys, n, code = [], [], []
            for t in batch.column(1).to_pylist():
                h = np.unique(shingle_hashes(t, SHINGLE))
                keys.append(xxhash.xxh128_digest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split())))
                n.append(len(h))
                code.append(fingerprint(h, WIDTH).view(np.int64))
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            flat = np.concatenate([np.empty(0, np.int64), *code])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * WIDTH, pa.int32()), pa.array(flat))], ["doc_id", "k1", "k2", "n", "code"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, k1 long, k2 long, n int, code array<long>")


def ring_mask(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Which 128-bit differences pass: from some segment on all chains keep their share, then the full count."""
    per = CHECK_SEGMENTS // 2
    width, ones = 64 // per, np.uint64((1 << (64 // per)) - 1)
    d = np.stack([np.bitwise_count((x >> np.uint64(width * i)) & ones) for x in (x1, x2) for i in range(per)]).astype(np.int64)
    chain, total = np.ones(d.shape, bool), np.zeros(d.shape, np.int64)
    for k in range(CHECK_SEGMENTS):
        total += np.roll(d, -k, axis=0)
        chain &= total * CHECK_SEGMENTS <= (k + 1) * CHECK_DIFF
    return chain.any(axis=0)


def _alike(n, c1, c2, i, j):
    """Which rows i and j may be near-duplicates by their numbers of shingles and the ring filter."""
    return (np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j])) & ring_mask(c1[i] ^ c1[j], c2[i] ^ c2[j])


def _connected(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """The connected components of links."""
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        up[root(x)] = root(y)
    out: dict[int, list[int]] = {}
    for x in up:
        out.setdefault(root(x), []).append(x)
    return list(out.values())


def _run_pairs(key, ids, n, c1, c2):
    """(a, b, crowds) of rows of equal key (sorted): the candidate pairs of runs that have FEW at most, and the crowds of the others.

    In other runs the rows that the filter connects, over whatever chain, are one crowd: the ids of
    its members, in order. Every candidate pair of the run is inside one crowd.
    """
    left, right, crowds = [], [], []
    edge = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    size = np.repeat(ends - starts, ends - starts)
    small = np.flatnonzero((size > 1) & (size <= SMALL_RUN))
    for s in range(1, SMALL_RUN):
        i = small[: -s or None][key[small[s:]] == key[small[: -s or None]]] if s < len(small) else small[:0]
        if not len(i):
            break
        i = i[_alike(n, c1, c2, i, i + s)]
        left.append(i)
        right.append(i + s)
    none = np.empty(0, np.int64)
    left, right = np.concatenate([none, *left]), np.concatenate([none, *right])
    of = np.searchsorted(starts, left, side="right") - 1
    dense = np.bincount(of, minlength=len(starts))[of] > FEW
    crowds += [np.sort(ids[c]) for c in _connected(left[dense], right[dense])]
    left, right = [ids[left[~dense]]], [ids[right[~dense]]]
    for a, b in zip(starts.tolist(), ends.tolist()) if (size > SMALL_RUN).any() else ():
        if b - a <= SMALL_RUN:
            continue
        rest = np.arange(a, b)
        while len(rest):
            queue, crowd, rest = [rest[0]], [rest[:1]], rest[1:]
            while queue and len(rest):
                hit = _alike(n, c1, c2, queue.pop(), rest)
                if hit.any():
                    found, rest = rest[hit], rest[~hit]
                    queue += found.tolist()
                    crowd.append(found)
            if len(crowd) > 1:
                crowds.append(np.sort(ids[np.concatenate(crowd)]))
    return np.concatenate([none, *left]), np.concatenate([none, *right]), crowds


def _united(t: pa.Table) -> pa.Table:
    """The crowds of one least member as one, a row for each member."""
    members = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in t.column("members").to_pylist()]))
    return pa.table({"label": pa.array(np.full(len(members), members[0])), "doc_id": pa.array(members)})


def candidate_pairs(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) and crowds (label, doc_id) of those of reps(doc_id, n, code) that share a 16-bit segment and pass the ring filter.

    Crowds of several segments that have the least member in common, as those of one large group mostly do, become one.
    """
    seg = lambda i: (F.shiftright(F.get("code", F.lit(i // 4)), 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF)) + F.lit(i << 16)).cast("int")
    rows = reps.select(F.explode(F.array(*[seg(i) for i in range(4 * WIDTH)])).alias("key"), "doc_id", "n", F.get("code", F.lit(0)).alias("c1"), F.get("code", F.lit(1)).alias("c2"))

    def run(batches):
        held = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            new = [new[0], new[1], new[2].astype(np.float64), new[3].view(np.uint64), new[4].view(np.uint64)]
            cols = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [c[cut:] for c in cols]
            if cut:
                yield out(_run_pairs(*[c[:cut] for c in cols]))
        if held is not None and len(held[0]):
            yield out(_run_pairs(*held))

    def out(found):
        a, b, crowds = found
        rows = [pa.array(np.concatenate([np.minimum(a, b), np.array([c[0] for c in crowds], np.int64)])), pa.array(np.concatenate([np.maximum(a, b), np.array([c[-1] for c in crowds], np.int64)]))]
        return pa.RecordBatch.from_arrays([*rows, pa.array([None] * len(a) + [c.tobytes() for c in crowds], pa.binary())], ["a", "b", "members"])

    found = stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, members binary"), "candidates")
    crowds = found.where("members is not null").select("a", "members").distinct().groupBy("a").applyInArrow(_united, "label long, doc_id long")
    return stored(found.where("members is null").select("a", "b").distinct(), "pairs"), stored(crowds, "crowds")


def _crowd_links(ids, n, codes, sets):
    """Verified links that connect all candidates of a crowd that are near-duplicates: a row is reached only over a pair whose shingles were compared."""
    c1, c2 = np.ascontiguousarray(codes[:, 0]), np.ascontiguousarray(codes[:, 1])
    left, right = [], []
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(size)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own, rest = np.zeros(len(names), bool), np.arange(len(ids))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.flatnonzero(_alike(n, c1, c2, at, rest))
            near = near[((codes[rest[near]] ^ codes[at]).view(np.uint16) == 0).any(axis=1)]  # a crowd's rows come from several segments
            if not len(near):
                continue
            mine = flat[ends[at] - size[at] : ends[at]]
            own[mine] = True
            hit = np.zeros(len(rest), bool)
            for k in range(0, len(near), BLOCK_ROWS):
                part = rest[near[k : k + BLOCK_ROWS]]
                upto = np.cumsum(size[part])
                where = np.arange(upto[-1]) + np.repeat(ends[part] - upto, size[part])
                both = np.add.reduceat(own[flat[where]], upto - size[part], dtype=np.int64)
                hit[near[k : k + BLOCK_ROWS]] = both >= SIMILARITY * (size[at] + size[part] - both)
            own[mine] = False
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                queue += found.tolist()
                left.append(np.full(len(found), ids[at]))
                right.append(ids[found])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def similar_pairs(df: DataFrame, reps: DataFrame, pairs: DataFrame, crowds: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) that connect all candidates, pairs(a, b) and within crowds(label, doc_id), whose sets of shingles have a Jaccard similarity of SIMILARITY or more.

    Pairs are compared one by one, crowds by a search that compares all pairs but those already connected.
    """

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t, SHINGLE)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "s"])

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILARITY * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    def search(batches):
        held, at = [], None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[0] != at and held:
                    yield linked(held)
                    held = []
                at = row[0]
                held.append(row[1:])
        if held:
            yield linked(held)

    def linked(rows):
        ids, codes, s = zip(*rows)
        s = [np.frombuffer(x, np.uint64) for x in s]
        pair = _crowd_links(np.array(ids, np.int64), np.array([len(x) for x in s], np.float64), np.array(codes, np.int64).view(np.uint64), s)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b"])

    named = pairs.select("a").union(pairs.select("b")).union(crowds.select("doc_id")).distinct().withColumnRenamed("a", "doc_id")
    own = stored(texts(df, id_col, text_col).join(named, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, s binary").dropDuplicates(["doc_id"]), "sets")
    with_a = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    both = with_a.join(own.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    few = both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")
    full = crowds.join(own.join(reps.select("doc_id", "code"), "doc_id"), "doc_id").select("label", "doc_id", "code", "s")
    many = full.repartition("label").sortWithinPartitions("label", "doc_id").mapInArrow(search, "a long, b long")
    return few.unionByName(many)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, root): every document that is not its group's smallest id, with that id.

    Groups are the connected components of near-duplicate texts: equal word sequences, or Jaccard
    similarity of SIMILARITY or more over SHINGLE-word shingles. At that similarity about 15 % of
    SimHash bits differ, too many for an exact search by segments, so candidates share one of the
    4 * WIDTH segments of a wide fingerprint (98 % of pairs at 0.8, more above) and pass the ring
    filter on its first 128 bits; each candidate is then compared by its shingles, unless compared
    pairs connect the two already. Rows without an id are in no group; rows that repeat an id are one document.
    """
    found = stored(sketches(df, id_col, text_col).where("doc_id is not null"), "sketches")
    classes = stored(found.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "code")).alias("r")).select("k1", "k2", "r.*"), "classes")
    copies = found.select("doc_id", "k1", "k2").join(classes.select("k1", "k2", F.col("doc_id").alias("rep")), ["k1", "k2"])
    reps = classes.where("n > 0").select("doc_id", "n", "code")
    roots = components(similar_pairs(df, reps, *candidate_pairs(reps), id_col, text_col)).withColumnRenamed("node", "rep")
    named = copies.join(roots, "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    return named.where("doc_id <> root").distinct()
