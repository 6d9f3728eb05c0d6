"""Removal of repeated passages: distributed prefix doubling over sampled positions.

The texts are dealt into groups by doc_id. Where they lie, the names of 8-byte strings double (8, 16,
32, then THRESHOLD bytes): the name of a string is that of the pair of names of its first and last
parts. At two lengths Spark sorts the named positions of all groups and ranks them, and what is
alone with its name leaves:

1. K bytes. Every THRESHOLD-byte string has one anchor, its leftmost K-byte string of least name.
   Equal strings have equal anchors at equal places, so only these sampled positions (about one in
   ten) take part; a string whose anchor no second document holds is alone.
2. Consecutive strings of one anchor form a run. An anchor whose runs are all alike is settled by its
   smallest document: a whole run is ranked at once.
3. THRESHOLD bytes. The strings of all other runs are ranked one by one; each class of equal strings
   belongs to its smallest document, and is removed in all others.

A group sends each name once, with its smallest document or whether it has several, so a passage that
a third of all documents share is at most one entry a group, and no rank has a hot key. Names travel
sorted and packed, a row for each group and range of names; what comes back is a bit for each name
sent or the anchors that are left. Exact copies of whole texts are settled first by a 128-bit digest
and take no part. Anchors have 40 bits, where a false match only costs a later rank; runs are told apart by
anchor and 64 bits more, strings by 96 bits.

Null texts are empty. Texts under the threshold lose nothing. Rows that repeat a doc_id are one
document to each other (nothing is removed between them); a null doc_id neither loses bytes nor
makes others lose any. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import bounded_batches, planes, stored, texts, unplaned

THRESHOLD = 50
#: Bytes of an anchor, and the least threshold.
K = 32
ANCHOR_BITS, PLACE_BITS = 40, 24
#: Bytes that are named at a time.
SLICE = 1 << 18
#: Bytes of text in a group, and in how many bytes of text a rank task's names arise.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20

SENT = "bucket int, g int, names binary, more binary, least binary, many binary"
SIDE = "g int, bucket int, open binary, gone binary, ids array<bigint>, digests array<bigint>"


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name for each pair of names."""
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (b ^ (b >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def named(raw: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Names of the strings of length bytes (8 or more) that start at each byte of raw."""
    if len(raw) < length:
        return np.empty(0, np.uint64)
    name, reach = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,)), 8
    if salt:
        name = name * np.uint64(2 * salt + 1) + np.uint64(salt)
    while reach < length:
        step = min(reach, length - reach)
        name, reach = _paired(name[:-step], name[step:]), reach + step
    return name


def runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, anchor, text) of all runs of the texts raw[starts[i]:ends[i]], which fill raw, each of threshold bytes or more."""
    out: list[tuple[np.ndarray, ...]] = []
    total = len(raw) - threshold + 1
    edges = np.sort(np.concatenate([starts, ends - threshold + 1]))  # strings that start from the second on cross a text's end
    for base in range(0, max(total, 0), SLICE):
        part = raw[base : min(base + SLICE, total) + threshold - 1]
        h = named(part, K)
        least = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        width, have = threshold - K + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        inside = edges[np.searchsorted(edges, base) : np.searchsorted(edges, base + len(least))] - base
        first = np.unique(np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, inside]))
        n = np.diff(first, append=len(least))
        text = np.searchsorted(starts, first + base, side="right") - 1
        on = first + base <= ends[text] - threshold
        # least names crowd near 0: a multiplication spreads them again
        anchor = ((least[first[on]] >> np.uint64(PLACE_BITS)) * np.uint64(0x9E3779B97F4A7C15 | 1)) & np.uint64((1 << ANCHOR_BITS) - 1)
        out.append((first[on] + base, n[on], anchor, text[on]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def packed(names: np.ndarray) -> bytes:
    """Names in order, as their differences."""
    return planes(np.diff(names, prepend=np.uint64(0)))


def unpacked(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(names, how many of each part) of packed names."""
    lists = [np.cumsum(unplaned(x).view(np.uint64), dtype=np.uint64) for x in parts]
    return np.concatenate([np.empty(0, np.uint64), *lists]), np.array([len(x) for x in lists], np.int64)


def _numbers(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *map(unplaned, parts)])


def _firsts(sorted_: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1]) if len(sorted_) else np.empty(0, np.int64)


class Group:
    """The texts of a group that may lose or lend bytes, one after another, and their runs by anchor."""

    def __init__(self, docs: pa.Table, side: pa.Table, threshold: int):
        import zstandard

        z = zstandard.ZstdDecompressor()
        self.threshold = threshold
        ids, digests, texts_ = (docs.column(k).to_pylist() for k in ("doc_id", "digest", "text"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts_[i]))
        copies = {(i, d) for a, b in zip(side.column("ids").to_pylist(), side.column("digests").to_pylist()) if a for i, d in zip(a, b)}
        self.rows = []  # (doc_id, number of its text or -1, its bytes if it has none)
        raws, own = [], []
        for i in order:
            t = z.decompress(texts_[i]) if texts_[i] else b""
            copy = (ids[i], digests[i]) in copies
            if copy or len(t) < threshold:
                self.rows.append((ids[i], -2 if copy else -1, t))
            else:
                self.rows.append((ids[i], len(raws), b""))
                own.append(ids[i])
                raws.append(t)
        self.raw = np.frombuffer(b"".join(raws), np.uint8)
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.own = np.array(own, np.int64)
        self.first, self.n, anchor, text = runs(self.raw, self.starts, self.ends, threshold)
        self.doc = self.own[text]
        #: Runs sorted by anchor, then document; where each anchor's begin; the anchors.
        self.order = np.argsort(anchor, kind="stable")
        self.anchor = anchor[self.order]
        self.begin = _firsts(self.anchor)
        self.anchors = self.anchor[self.begin]

    def reduced(self, f, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return f.reduceat(x, begin) if len(begin) else x[:0]

    def of_anchor(self, flags: np.ndarray) -> np.ndarray:
        """A value for each anchor, for each run in order."""
        return np.repeat(flags, np.diff(self.begin, append=len(self.order)))

    def among(self, parts: pa.ChunkedArray) -> np.ndarray:
        """Which anchors are in packed lists."""
        return np.isin(self.anchors, unpacked([x for x in parts.to_pylist() if x])[0])

    def strings(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, document, name, second name) of all strings of the runs (places in order) that are on, by name, then document."""
        r = self.order[on]
        first, n = self.first[r], self.n[r]
        size = n + self.threshold - 1
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + size, size)
        own = self.raw[at]
        where = np.arange(int(n.sum())) + np.repeat(ends - size - np.cumsum(n) + n, n)
        name, second = named(own, self.threshold)[where], named(own, self.threshold, 0x2545F491)[where] >> np.uint64(32)
        place, doc = at[where], np.repeat(self.doc[r], n)
        order = np.lexsort((doc, second, name))
        return place[order], doc[order], name[order], second[order]


def _rows(g: int, buckets: int, top: np.ndarray, bits: int, **parts) -> pa.Table:
    """A row for each range of names that has any: top are the names' leading bits, in order; parts are (array, packer)."""
    cut = np.append(np.searchsorted(top, np.array([-(-(b << bits) // buckets) for b in range(buckets)], np.uint64)), len(top))
    full = np.flatnonzero(np.diff(cut)).tolist()
    made = {k: [f(x[cut[b] : cut[b + 1]]) for b in full] for k, (x, f) in parts.items()}
    none = [None] * len(full)
    return pa.table([pa.array(full, pa.int32()), pa.array([g] * len(full), pa.int32()), *(pa.array(made.get(k, none), pa.binary()) for k in ("names", "more", "least", "many"))], ["bucket", "g", "names", "more", "least", "many"])


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _answers(side: pa.Table, column: str) -> np.ndarray:
    """The bits that came back for the names sent, in the order sent."""
    rows = sorted((b, x) for b, x in zip(side.column("bucket").to_pylist(), side.column(column).to_pylist()) if b is not None and x)
    out = [np.unpackbits(np.frombuffer(x[4:], np.uint8), count=int.from_bytes(x[:4], "little")) for _, x in rows]
    return np.concatenate([np.empty(0, np.uint8), *out]).astype(bool)


def _answer(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(4, "little") + _bits(bits)


def _many(t: pa.Table, size: np.ndarray) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(t.column("many").to_pylist(), size.tolist())]) > 0


def _back(t: pa.Table, open_: list[bytes], gone: list[bytes] | None) -> pa.Table:
    n = t.num_rows
    return pa.table([t.column("g"), t.column("bucket"), pa.array(open_, pa.binary()), pa.array(gone or [None] * n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], ["g", "bucket", "open", "gone", "ids", "digests"])


def rank_anchors(t: pa.Table) -> pa.Table:
    """For each name sent, a bit: whether a second document holds it."""
    h, size = unpacked(t.column("names").to_pylist())
    many = _many(t, size)
    order = np.argsort(h, kind="stable")
    begin = _firsts(h[order])
    span = np.diff(begin, append=len(h))
    shared = np.empty(len(h), bool)
    shared[order] = np.repeat((span > 1) | np.logical_or.reduceat(many[order], begin), span)
    ends = np.cumsum(size).tolist()
    return _back(t, [_answer(shared[a:b]) for a, b in zip([0, *ends], ends)], None)


def rank_runs(t: pa.Table) -> pa.Table:
    """The anchors sent whose runs differ (open), and those of which all runs are alike and another group has a smaller document (gone)."""
    h, size = unpacked(t.column("names").to_pylist())
    digest, least = np.frombuffer(b"".join(t.column("more").to_pylist()), "<u8"), _numbers(t.column("least").to_pylist())
    many = _many(t, size)
    order = np.argsort(h, kind="stable")
    begin = _firsts(h[order])
    span = np.diff(begin, append=len(h))
    unlike = np.logical_or.reduceat(many[order], begin) | (np.minimum.reduceat(digest[order], begin) != np.maximum.reduceat(digest[order], begin))
    open_, gone = np.empty(len(h), bool), np.empty(len(h), bool)
    open_[order] = np.repeat(unlike, span)
    gone[order] = (np.repeat(np.minimum.reduceat(least[order], begin), span) < least[order]) & ~open_[order]
    ends = np.cumsum(size).tolist()
    cuts = list(zip([0, *ends], ends))
    return _back(t, [packed(h[a:b][open_[a:b]]) for a, b in cuts], [packed(h[a:b][gone[a:b]]) for a, b in cuts])


def rank_strings(t: pa.Table) -> pa.Table:
    """For each name sent, a bit: whether another group has a smaller document that holds it."""
    h, size = unpacked(t.column("names").to_pylist())
    second, least = np.frombuffer(b"".join(t.column("more").to_pylist()), "<u4"), _numbers(t.column("least").to_pylist())
    order = np.lexsort((second, h))
    first, then = h[order], second[order]
    begin = np.concatenate([[0], np.flatnonzero((first[1:] != first[:-1]) | (then[1:] != then[:-1])) + 1])
    gone = np.empty(len(h), bool)
    gone[order] = np.repeat(np.minimum.reduceat(least[order], begin), np.diff(begin, append=len(h))) < least[order]
    ends = np.cumsum(size).tolist()
    return _back(t, [_answer(gone[a:b]) for a, b in zip([0, *ends], ends)], None)


def dedup(df: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of every row."""
    if threshold < K:
        raise ValueError(f"the threshold must be {K} bytes or more")
    spark = df.sparkSession
    bounded_batches(spark, mb=8)
    rows = texts(df, id_col, text_col)
    known = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("digest"), F.xxhash64(F.lit(1), "text").alias("d2"), F.octet_length("text").cast("long").alias("n"))
    keys = stored(known, "keys")
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups, buckets = max(1, -(-total // GROUP_BYTES)), max(1, -(-total // BUCKET_BYTES))
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g")
    own = keys.where(F.col("n") >= threshold).groupBy(dealt, "digest", "d2").agg(F.collect_set("doc_id").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))  # a group's documents, at most
    least = own.groupBy("digest", "d2").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("most > least")
    copied = own.join(least, ["digest", "d2"]).select("g", "digest", F.explode(F.filter("ids", lambda x: x > F.col("least"))).alias("doc_id"))
    none = F.lit(None).cast("binary")
    copies = stored(copied.groupBy("g").agg(F.collect_list(F.struct("doc_id", "digest")).alias("c")).select("g", F.lit(None).cast("int").alias("bucket"), none.alias("open"), none.alias("gone"), F.col("c.doc_id").alias("ids"), F.col("c.digest").alias("digests")), "copies")  # a group's documents, at most

    def squeeze(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([z.compress(t.as_py().encode()) if t.is_valid else b"" for t in batch.column(3)], pa.binary())], ["g", "doc_id", "digest", "text"])

    docs = rows.where("doc_id is not null").select(dealt, "doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(squeeze, "g int, doc_id long, digest long, text binary")

    def each(side: DataFrame, f, schema: str) -> DataFrame:
        """f(group's number, Group, side rows) for every group; the exchange of texts is the same in all steps."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return f(left.column("g")[0].as_py() if left.num_rows else 0, Group(left, right, threshold), right)

        return docs.groupBy("g").cogroup(side.groupBy("g")).applyInArrow(run, schema)

    def send_anchors(g, group, side):
        doc = group.doc[group.order]
        many = group.reduced(np.minimum, doc, group.begin) != group.reduced(np.maximum, doc, group.begin)
        return _rows(g, buckets, group.anchors, ANCHOR_BITS, names=(group.anchors, packed), many=(many, _bits))

    def send_runs(g, group, side):
        import xxhash

        shared = _answers(side, "open")
        on = np.flatnonzero(group.of_anchor(shared))
        r = group.order[on]
        first = group.first[r]
        raw, digest = memoryview(group.raw), xxhash.xxh3_64_intdigest
        c = np.fromiter((digest(raw[a:b]) for a, b in zip(first.tolist(), (first + group.n[r] + (threshold - 1)).tolist())), np.uint64, len(r))
        begin = _firsts(group.anchor[on])
        one = group.reduced(np.minimum, c, begin)
        many = one != group.reduced(np.maximum, c, begin)
        return _rows(g, buckets, group.anchors[shared], ANCHOR_BITS, names=(group.anchors[shared], packed), more=(one, lambda x: x.astype("<u8").tobytes()), least=(group.reduced(np.minimum, group.doc[r], begin), planes), many=(many, _bits))

    def classes(group, side):
        """Strings of open runs, where their classes begin, and which anchors are open."""
        opened = group.among(side.column("open").filter(pc.is_valid(side.column("gone"))))
        place, doc, name, second = group.strings(np.flatnonzero(group.of_anchor(opened)))
        new = (name[1:] != name[:-1]) | (second[1:] != second[:-1])
        begin = np.concatenate([[0], np.flatnonzero(new) + 1]) if len(name) else np.empty(0, np.int64)
        return place, doc, name, second, begin, opened

    def send_strings(g, group, side):
        _, doc, name, second, begin, _ = classes(group, side)
        return _rows(g, buckets, name[begin], 64, names=(name[begin], packed), more=(second[begin], lambda x: x.astype("<u4").tobytes()), least=(doc[begin], planes))

    def finish(g, group, side):
        place, doc, _, _, begin, opened = classes(group, side)
        width = np.diff(begin, append=len(doc))
        # a class belongs to the smallest document of all groups, an anchor that is not open to the smallest that holds it
        lost = np.repeat(_answers(side.filter(pc.is_null(side.column("gone"))), "open"), width) | (doc > np.repeat(doc[begin], width))
        turn = np.zeros(len(group.raw) + 1, np.int32)
        np.add.at(turn, place[lost], 1)
        np.add.at(turn, place[lost] + 1, -1)
        by = group.doc[group.order]
        gone = group.of_anchor(group.among(side.column("gone"))) | (by > group.of_anchor(group.reduced(np.minimum, by, group.begin)))
        r = group.order[gone & ~group.of_anchor(opened)]
        np.add.at(turn, group.first[r], 1)
        np.add.at(turn, group.first[r] + group.n[r], -1)
        started = np.concatenate([np.zeros(threshold, np.int32), np.cumsum(np.cumsum(turn[:-1]) > 0, dtype=np.int32)])
        covered = started[threshold:] > started[:-threshold]
        out = []
        for i, at, raw in group.rows:
            if at >= 0:
                raw, over = group.raw[group.starts[at] : group.ends[at]], covered[group.starts[at] : group.ends[at]]
                n = int(over.sum())
                kept = raw[~over].tobytes() if n else raw.tobytes()
                out.append((i, len(raw), n, int(over[0]) + int((over[1:] & ~over[:-1]).sum()), hashlib.sha256(kept).hexdigest(), *[kept][:keep_text]))
            else:
                kept = raw if at == -1 else b""
                out.append((i, len(raw), len(raw) - len(kept), int(at == -2), hashlib.sha256(kept).hexdigest(), *[kept][:keep_text]))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * (5 + keep_text), kinds)], names[: 5 + keep_text])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    ranked = lambda sent, f: sent.groupBy("bucket").applyInArrow(f, SIDE)
    anchors = ranked(each(copies, send_anchors, SENT), rank_anchors)
    settled = stored(ranked(each(copies.unionByName(anchors), send_runs, SENT), rank_runs), "runs").unionByName(copies)
    strings = ranked(each(settled, send_strings, SENT), rank_strings)
    made = each(settled.unionByName(strings), finish, schema)
    unnamed = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *[F.col("text").cast("binary").alias("kept")][:keep_text])
    return made.unionByName(unnamed)
