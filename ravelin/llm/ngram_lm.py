"""Language-model scoring with an Elias-Fano trigram trie.

Words are lower-cased in A-Z; each text is its words and one end token. All training texts are
counted, and no n-gram is left out. The vocabulary level holds the 64-bit hashes of all training words
as Elias-Fano sequences, with exact counts; a word's id is its rank. The bigram and trigram levels hold,
for each context (a word's id, a bigram's rank), a monotone pointer (Elias-Fano) to its successors,
which are one monotone sequence, also Elias-Fano coded, and 16-bit codes, even in the logarithm, of each
n-gram's discounted probability and of each context's back-off weight. A bigram's successor is a word's id;
a trigram's is relative to its context: the last word's place among the successors of the word before it,
so that its numbers are bounded by the most successors of a word, not by the vocabulary. A query finds an
n-gram by searching the successor within its context's range of that sequence.

Probabilities are interpolated with absolute discounting over the add-DELTA unigram estimate:
p(w | h) = max(c(h w) - DISCOUNT, 0) / c(h) + DISCOUNT D(h) / c(h) p(w | h'), where D(h) is the number
of distinct successors and h' is h without its first word; an unknown h leaves all to h'. The levels hold
the first term and the weight of p(w | h'), each within 0.02 % in shards whose values span nine orders.
If a caller asks for a minimum of word occurrences, all rarer words are one word within contexts.

Texts are tokenised twice: to count words, and to store their ids, which all later steps read. Tasks
count n-grams over many texts at a time and send each one once, in sorted, packed runs of n-grams.
Levels are cut into shards by ranges of whole n-grams, taken from a sample so that a shard has about
SHARD of them: a context with many successors is cut as well, and its successors and occurrences are added up
over its shards. An n-gram is one 63-bit number while contexts times successors allow it, and two numbers
(of 53 bits) beyond, so no size stops the training. A shard is built by one task and put into the shared folder under its final name at
once where that is a file system, so a repeated task changes nothing. Workers map the files there, and read
them through Arrow's file systems elsewhere; MOST_OPEN shards of a level are held at a time.

Null texts are empty (one end token); a null id counts as the empty text in the fold. Repeated rows
count each time. With no training text at all, only the unigram estimate's floor is left. Other
columns are not read. Distinct words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import collections
import json
import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import bounded_batches, fresh_path, let_go, planes, stored, unplaned

DELTA = 0.1
DISCOUNT = 0.75
MIN_WORD = 1
#: N-grams of a shard, about; bytes of text whose words are one shard of the vocabulary.
SHARD, WORD_BYTES = 1 << 20, 64 << 20
#: Tokens whose n-grams a task sorts at a time, distinct words it counts or remembers at a time.
CHUNK, WORDS = 1 << 20, 1 << 20
#: Sampled n-grams for each shard.
SAMPLED = 64
#: From how many contexts times successors on n-grams are two numbers.
ONE_NUMBER = 1 << 62
MOST_OPEN = 64
#: Values that are coded at a time, a multiple of eight.
BLOCK = 1 << 13
FOLDS = 10
BATCH_ROWS, BATCH_MB = 1000, 8
#: Hash key of the end token, which no word can be.
END = b" "


# ---- Elias-Fano sequences -------------------------------------------------------------------------


_1, _2, _3, _4, _8, _255 = (np.uint64(x) for x in (1, 2, 3, 4, 8, 255))
_PAIRS, _FOURS, _NIBBLES, _BYTES, _TOPS = (np.uint64(int(x * 16, 16) if len(x) == 1 else int(x * 8, 16)) for x in ("5", "3", "0f", "01", "80"))
#: Place of the r-th one of each byte, at 256 * r + byte.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [8] * 8)[r] for r in range(8) for byte in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence below a bound: low bits packed, high bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, width: int):
        self.low, self.high, self.n, self.width = low, high, n, width
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones
        self.loads = np.ndarray((max(len(low) - 7, 0),), "<u8", low, 0, (1,))

    @staticmethod
    def encode(values: np.ndarray, bound: int) -> "EliasFano":
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, (bound // max(n, 1)).bit_length() - 1)
        every = np.arange(width, dtype=np.uint64)
        bits = lambda x: np.packbits(((x[:, None] >> every) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        low = np.concatenate([*(bits(values[a : a + BLOCK]) for a in range(0, n, BLOCK)), np.zeros(8, np.uint8)])
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        marks = np.zeros(-(-(n + (bound >> width) + 2) // 64) * 64, np.uint8)
        marks[places] = 1
        return EliasFano(low, np.packbits(marks, bitorder="little").view("<u8"), n, width)

    def arrays(self) -> dict:
        return {"low": self.low, "high": self.high, "meta": np.array([self.n, self.width], np.int64)}

    @staticmethod
    def of(arrays: dict, name: str) -> "EliasFano":
        n, width = arrays[f"{name}.meta"].tolist()
        return EliasFano(arrays[f"{name}.low"], arrays[f"{name}.high"], n, width)

    def _select(self, k: np.ndarray, cumulated: np.ndarray, flip: bool) -> np.ndarray:
        """Bit position of the k-th (from 0) one, or zero if flip."""
        word = np.minimum(np.searchsorted(cumulated, k, side="right") - 1, len(self.high) - 1)
        bits = ~self.high[word] if flip else self.high[word]
        left = (k - cumulated[word]).astype(np.uint64)
        # ones of each byte, then of all bytes up to it; the byte wanted is the first whose sum is above left
        ones = bits - ((bits >> _1) & _PAIRS)
        ones = (ones & _FOURS) + ((ones >> _2) & _FOURS)
        upto = ((ones + (ones >> _4)) & _NIBBLES) * _BYTES
        at = np.bitwise_count(((left * _BYTES) | _TOPS) - upto & _TOPS).astype(np.uint64) << _3
        left -= ((upto << _8) >> at) & _255
        return 64 * word + at.astype(np.int64) + _IN_BYTE[(left << _8 | ((bits >> at) & _255)).astype(np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        return (self.loads[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, self.ones, False) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def find(self, v: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, within first..last - 1 if given; -1 where it is not there."""
        if not self.n:
            return np.full(len(v), -1, np.int64)
        high, low = (v >> np.uint64(self.width)).astype(np.int64), v & np.uint64((1 << self.width) - 1)
        a = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) + 1 - high, 0)
        b = self._select(high, self.zeros, True) - high
        if first is not None:
            a, b = np.maximum(a, first), np.minimum(b, last)
        end = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < low[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        hit = (a < end) & (self._low(np.minimum(a, self.n - 1)) == low)
        return np.where(hit, a, -1)


# ---- files in the shared folder -------------------------------------------------------------------


def put_file(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write named arrays under the final name at once; the same task writes the same bytes."""
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = (v.dtype.str, len(v), at)
        at += -(-v.nbytes // 8) * 8
    raw = json.dumps(head).encode()
    raw += b" " * (-len(raw) % 8)

    def pour(f):
        f.write(len(raw).to_bytes(8, "little") + raw)
        for v in arrays.values():
            b = np.ascontiguousarray(v).tobytes()
            f.write(b + b"\0" * (-len(b) % 8))

    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        with open(tmp := f"{url.path}.{uuid.uuid4().hex}", "wb") as f:
            pour(f)
        os.replace(tmp, url.path)
    else:
        from pyarrow.fs import FileSystem

        fs, p = FileSystem.from_uri(path)
        fs.create_dir(os.path.dirname(p), recursive=True)
        with fs.open_output_stream(p) as f:
            pour(f)


def get_file(path: str) -> dict[str, np.ndarray]:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        raw = np.memmap(url.path, np.uint8, "r")
    else:
        from pyarrow.fs import FileSystem

        fs, p = FileSystem.from_uri(path)
        with fs.open_input_file(p) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    return {k: raw[8 + n + at : 8 + n + at + size * np.dtype(t).itemsize].view(t) for k, (t, size, at) in json.loads(raw[8 : 8 + n].tobytes()).items()}


# ---- tokens and words -----------------------------------------------------------------------------


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


class Open(dict):
    """The shards that are open, MOST_OPEN at most: the first opened goes first."""

    def __init__(self, load):
        super().__init__()
        self.load = load

    def __missing__(self, s):
        if len(self) >= MOST_OPEN:
            del self[next(iter(self))]
        self[s] = self.load(s)
        return self[s]

    def __reduce__(self):
        return Open, (self.load,)


def count_words(docs: DataFrame, bits: int) -> DataFrame:
    """(s, h, c): sorted hashes of words of docs(text) and their occurrences, packed, by the hashes' leading bits."""

    def run(batches):
        seen: collections.Counter = collections.Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            seen[END] += len(texts)
            for t in texts:
                seen.update(split(t))
            if len(seen) > WORDS:
                yield packed(seen)
                seen.clear()
        if seen:
            yield packed(seen)

    def packed(seen):
        h, c = np.fromiter(map(word_hash, seen), np.uint64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen))
        order = np.argsort(h)
        h, c = h[order], c[order]
        top = leading(h, bits)
        at = np.searchsorted(top, np.arange((1 << bits) + 1))
        rows = [(s, h[x:y].tobytes(), c[x:y].tobytes()) for s, x, y in zip(range(1 << bits), at.tolist(), at[1:].tolist()) if x < y]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["s", "h", "c"])

    return docs.select("text").mapInArrow(run, "s int, h binary, c binary")


def leading(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Vocabulary:
    """The vocabulary level: shards by the top bits of the hash; a word's id is its rank."""

    def __init__(self, path: str, bits: int, starts: list[int]):
        self.path, self.bits, self.starts = path, bits, np.array(starts, np.int64)
        self.open = Open(self.load)

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    def load(self, s: int):
        f = get_file(f"{self.path}/words-{s}")
        return EliasFano.of(f, "hashes"), f["counts"]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Id or -1 of each hash."""
        ids = np.full(len(h), -1, np.int64)
        of = leading(h, self.bits)
        for s in np.unique(of).tolist():
            if self.starts[s] < self.starts[s + 1]:
                mine = np.flatnonzero(of == s)
                at = self.open[s][0].find(h[mine] & np.uint64((1 << (64 - self.bits)) - 1))
                ids[mine] = np.where(at >= 0, self.starts[s] + at, -1)
        return ids

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Occurrences of each id; 0 for what is no id."""
        distinct, back = np.unique(ids, return_inverse=True)
        c = np.zeros(len(distinct), np.int64)
        of = np.searchsorted(self.starts, distinct, side="right") - 1
        for s in np.unique(of).tolist():
            if 0 <= s < len(self.starts) - 1:
                mine = of == s
                c[mine] = self.open[s][1][distinct[mine] - self.starts[s]]
        return c[back]


def build_vocabulary(words: DataFrame, bits: int, path: str) -> tuple[Vocabulary, int]:
    """The vocabulary and the number of tokens."""

    def build(t: pa.Table) -> pa.Table:
        h, c = (np.frombuffer(b"".join(t.column(k).to_pylist()), kind) for k, kind in (("h", np.uint64), ("c", np.int64)))
        h, c = summed(h, c)
        s = t.column("s")[0].as_py()
        ef = EliasFano.encode(h & np.uint64((1 << (64 - bits)) - 1), 1 << (64 - bits))
        put_file(f"{path}/words-{s}", {**{f"hashes.{k}": v for k, v in ef.arrays().items()}, "counts": c})
        return pa.table({"s": pa.array([s], pa.int32()), "n": pa.array([len(h)], pa.int64()), "total": pa.array([int(c.sum())], pa.int64())})

    made = {r.s: r for r in words.groupBy("s").applyInArrow(build, "s int, n long, total long").collect()}  # a row for each shard
    starts = [0]
    for s in range(1 << bits):
        starts.append(starts[-1] + (made[s].n if s in made else 0))
    return Vocabulary(path, bits, starts), sum(r.total for r in made.values())


class Ids(dict):
    """Place of each word met, at most about WORDS of them, and their ids."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.new = vocabulary, []
        self.ids = np.empty(0, np.int64)
        self[END]

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        self.new.append(word)
        return len(self) - 1

    def of(self, places: list[int]) -> np.ndarray:
        self.ids = np.concatenate([self.ids, self.vocabulary.find(np.fromiter(map(word_hash, self.new), np.uint64, len(self.new)))])
        self.new = []
        return self.ids[np.array(places, np.int64)]


def numbered(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, held_out, ids) of docs(doc_id, held_out, text): the ids of each text's tokens, the end's last, -1 for unknown words."""
    wide = np.dtype(np.int32 if vocabulary.size < 1 << 31 else np.int64)

    def run(batches):
        known = Ids(vocabulary)
        for batch in batches:
            if len(known) > WORDS:
                known = Ids(vocabulary)
            places: list[int] = []
            ends: list[int] = [0]
            end, get = known[END], known.__getitem__
            for t in batch.column(2).to_pylist():
                places += map(get, split(t))
                places.append(end)
                ends.append(len(places))
            flat = known.of(places).astype(wide)
            offsets = np.array(ends, np.int64) * wide.itemsize
            blob = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blob], ["doc_id", "held_out", "ids"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, ids binary")


def gathered(batches, column: int, wide: np.dtype):
    """(batches, ids of all their texts, end of each text) for about CHUNK tokens at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes // wide.itemsize
        if n >= CHUNK:
            yield joined(held, column, wide)
            held, n = [], 0
    if held:
        yield joined(held, column, wide)


def joined(held: list, column: int, wide: np.dtype):
    raw = [x for b in held for x in b.column(column).to_pylist()]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))) // wide.itemsize
    return held, np.frombuffer(b"".join(raw), wide).astype(np.int64), ends


def before(ids: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """What stands before each token, start at the beginning of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.concatenate([[0], ends[:-1]])[: len(ends)]] = start
    return out


# ---- levels of n-grams ----------------------------------------------------------------------------


class Keys:
    """N-grams of a level as numbers that sort by context, then successor: context x bound + successor, or complex numbers of both where that is too large."""

    def __init__(self, contexts: int, bound: int):
        self.bound, self.two = bound, contexts * bound >= ONE_NUMBER

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(np.complex128 if self.two else np.int64)

    def of(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        return context + 1j * successor if self.two else context * self.bound + successor

    def parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, successor)"""
        if self.two:
            return keys.real.astype(np.int64), keys.imag.astype(np.int64)
        context = keys // self.bound
        return context, keys - context * self.bound

    def packed(self, keys: np.ndarray) -> bytes:
        """Keys in order, as differences."""
        if not self.two:
            return planes(np.diff(keys, prepend=0))
        context, successor = self.parts(keys)
        first = planes(np.diff(context, prepend=0))
        return len(first).to_bytes(8, "little") + first + planes(successor)

    def unpacked(self, raw: bytes) -> np.ndarray:
        if not self.two:
            return np.cumsum(unplaned(raw))
        n = 8 + int.from_bytes(raw[:8], "little")
        return self.of(np.cumsum(unplaned(raw[8:n])), unplaned(raw[n:]))


def counted(numbers: DataFrame, keys: Keys, keys_of, cuts: np.ndarray, wide: np.dtype) -> DataFrame:
    """(s, k, c): sorted distinct keys and their counts, packed, by ranges that begin at cuts; keys_of(ids, ends) are a chunk's."""

    def run(batches):
        for _, ids, ends in gathered(batches, 0, wide):
            found, c = np.unique(keys_of(ids, ends), return_counts=True)
            at = [0, *np.searchsorted(found, cuts).tolist(), len(found)]
            rows = [(s, keys.packed(found[x:y]), planes(c[x:y])) for s, (x, y) in enumerate(zip(at, at[1:])) if x < y]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["s", "k", "c"])

    return numbers.select("ids").mapInArrow(run, "s int, k binary, c binary")


def ranges(numbers: DataFrame, keys: Keys, keys_of, tokens: int, wide: np.dtype) -> np.ndarray:
    """Where the shards of a level begin but for the first: quantiles of SAMPLED keys for each, as often as chunks send them. They only deal out work."""
    shards = -(-tokens // SHARD)
    if shards <= 1:
        return np.empty(0, keys.dtype)
    every = max(1, tokens // (shards * SAMPLED))

    def run(batches):
        at = 0
        for _, ids, ends in gathered(batches, 0, wide):
            n = len(ids)
            take = np.arange(-at % every, n, every)
            at += n
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(keys_of(ids, ends, take)).tobytes()], pa.binary())], ["k"])

    rows = numbers.select("ids").mapInArrow(run, "k binary").collect()  # SAMPLED numbers for each shard
    found = np.sort(np.frombuffer(b"".join(r.k for r in rows), keys.dtype))
    return np.unique(found[np.arange(1, shards) * len(found) // shards]) if len(found) else found


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes of positive numbers, even in the logarithm, and (logarithm of code 0, step)."""
    logs = np.log(x)
    low = float(logs.min(initial=np.inf)) if len(x) else 0.0
    step = max((float(logs.max(initial=low)) - low) / 65535, 1e-12)
    return np.rint((logs - low) / step).astype(np.uint16), np.array([low, step])


def valued(codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.exp(scale[0] + scale[1] * codes)


class Level:
    """N-grams by context and successor, in shards by ranges of both; an n-gram's rank counts over all shards.

    edges are the contexts that shards begin with, in order, which may go on from the shard before: their first rank, their
    number of successors and their occurrences over all shards.
    """

    def __init__(self, path: str, keys: Keys, cuts: np.ndarray, starts: np.ndarray, edges: np.ndarray, edge_firsts: np.ndarray, edge_sizes: np.ndarray, edge_sums: np.ndarray, most: int):
        self.path, self.keys, self.cuts, self.starts = path, keys, cuts, starts
        self.edges, self.edge_firsts, self.edge_sizes, self.edge_sums, self.most = edges, edge_firsts, edge_sizes, edge_sums, most
        self.open = Open(self.load)

    def load(self, s: int):
        f = get_file(f"{self.path}-{s}")
        return (int(f["base"][0]), EliasFano.of(f, "pointers"), EliasFano.of(f, "successors"), *(f[k] for k in ("codes", "scale", "weights", "weight_scale", "sums")))

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rank or -1, discounted probability or 0, weight of the shorter context, rank of the context's first) of n-grams in the order of their keys.

        A context that is not there has the weight 1 and the first -1.
        """
        n = len(context)
        rank, probability, weight, begin = np.full(n, -1, np.int64), np.zeros(n), np.ones(n), np.full(n, -1, np.int64)
        edge = np.minimum(np.searchsorted(self.edges, context), len(self.edges) - 1) if len(self.edges) else np.zeros(n, np.int64)
        at_edge = self.edges[edge] == context if len(self.edges) else np.zeros(n, bool)
        of = np.searchsorted(self.cuts, self.keys.of(context, successor), side="right")
        turns = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [n]])
        for x, y in zip(turns[:-1].tolist(), turns[1:].tolist()):
            s = int(of[x]) if x < y else -1
            if s < 0 or self.starts[s] == self.starts[s + 1]:
                continue
            base, pointers, successors, codes, scale, weights, weight_scale, sums = self.open[s]
            local = context[x:y] - base
            there = np.flatnonzero((local >= 0) & (local < pointers.n - 1))
            local = local[there]
            new = np.concatenate([[True], local[1:] != local[:-1]])[: len(local)]
            each, of_each = local[new], np.cumsum(new) - 1
            first, last = pointers.access(each).astype(np.int64)[of_each], pointers.access(each + 1).astype(np.int64)[of_each]
            on = np.flatnonzero(last > first)
            begin[x + there[on]] = self.starts[s] + first[on]
            weight[x + there[on]] = valued(weights[local[on]], weight_scale)
            v = local[on].astype(np.uint64) * np.uint64(self.keys.bound) + successor[x + there[on]].astype(np.uint64)
            at = successors.find(v, first[on], last[on])
            hit = at >= 0
            where = x + there[on[hit]]
            rank[where] = self.starts[s] + at[hit]
            # the shard's own sum is in the code: for a context that other shards share, the sum over all of them takes its place
            shared = np.where(at_edge[where], sums[(local[on[hit]] > 0).astype(np.int64)] / self.edge_sums[edge[where]] if len(self.edges) else 1.0, 1.0)
            probability[where] = valued(codes[at[hit]], scale) * shared
        e = edge[at_edge]
        begin[at_edge], weight[at_edge] = self.edge_firsts[e], DISCOUNT * self.edge_sizes[e] / self.edge_sums[e]
        return rank, probability, weight, begin


def build_level(rows: DataFrame, keys: Keys, cuts: np.ndarray, path: str) -> Level:

    def build(t: pa.Table) -> pa.Table:
        s = t.column("s")[0].as_py()
        found, c = summed(np.concatenate([keys.unpacked(x) for x in t.column("k").to_pylist()]), np.concatenate([unplaned(x) for x in t.column("c").to_pylist()]))
        context, successor = keys.parts(found)
        base, last = int(context[0]), int(context[-1])
        context -= base
        sizes, sums = np.bincount(context, minlength=last - base + 1), np.bincount(context, c, last - base + 1)
        pointers = EliasFano.encode(np.concatenate([[0], np.cumsum(sizes)]), len(found) + 1)
        successors = EliasFano.encode(context.astype(np.uint64) * np.uint64(keys.bound) + successor.astype(np.uint64), (last - base + 1) * keys.bound)
        codes, scale = quantised((c - DISCOUNT) / sums[context])
        full = sizes > 0
        weights = np.zeros(len(sizes), np.uint16)
        weights[full], weight_scale = quantised(DISCOUNT * sizes[full] / sums[full])
        ends = {"of_first": int(sizes[0]), "sum_first": int(sums[0]), "of_last": int(sizes[-1]), "sum_last": int(sums[-1])}
        files = {f"{k}.{x}": v for k, ef in (("pointers", pointers), ("successors", successors)) for x, v in ef.arrays().items()}
        files |= {"codes": codes, "scale": scale, "weights": weights, "weight_scale": weight_scale, "base": np.array([base], np.int64), "sums": sums[[0, -1]]}
        put_file(f"{path}-{s}", files)
        return pa.table({k: pa.array([v], pa.int64()) for k, v in ({"s": s, "n": len(found), "first": base, "last": last, "most": int(sizes.max())} | ends).items()})

    made = {r.s: r for r in rows.groupBy("s").applyInArrow(build, "s long, n long, first long, last long, most long, of_first long, sum_first long, of_last long, sum_last long").collect()}  # a row for each shard
    starts = np.cumsum([0, *(made[s].n if s in made else 0 for s in range(len(cuts) + 1))])
    held: dict[int, list[int]] = {}  # of each context at an end of a shard: first rank, successors, occurrences
    for s in sorted(made):
        r = made[s]
        for context, first, n, total in {r.first: (r.first, starts[s], r.of_first, r.sum_first), r.last: (r.last, starts[s + 1] - r.of_last, r.of_last, r.sum_last)}.values():
            x = held.setdefault(context, [int(first), 0, 0])
            x[1], x[2] = x[1] + n, x[2] + total
    edges = sorted({r.first for r in made.values()})
    most = max([r.most for r in made.values()] + [held[x][1] for x in edges], default=0)
    return Level(path, keys, cuts, starts, np.array(edges, np.int64), *(np.array([held[x][i] for x in edges], np.int64) for i in range(3)), most)


class Model:
    """vocabulary, levels and totals. Two ids follow the words': the start's, and that of all words too rare for contexts."""

    def __init__(self, vocabulary: Vocabulary, total: int, min_word: int):
        self.vocabulary, self.total, self.min_word = vocabulary, total, min_word
        self.start, self.rare = vocabulary.size, vocabulary.size + 1
        self.pairs = Keys(vocabulary.size + 2, vocabulary.size + 2)
        self.triples = Keys(0, 1)
        self.bigrams: Level | None = None
        self.trigrams: Level | None = None
        self.wide = np.dtype(np.int32 if vocabulary.size < 1 << 31 else np.int64)

    def with_bigrams(self, level: Level) -> None:
        """Trigrams are numbered by these bigrams. One successor more than a word has stands for bigrams that are not there."""
        self.bigrams, self.triples = level, Keys(int(level.starts[-1]), level.most + 1)

    def inner(self, ids: np.ndarray) -> np.ndarray:
        """Ids within n-grams."""
        if self.min_word > 1:
            return np.where(self.vocabulary.counts(ids) >= self.min_word, ids, self.rare)
        return np.where(ids >= 0, ids, self.rare)

    def bigram_keys(self, ids: np.ndarray, ends: np.ndarray, take=slice(None)) -> np.ndarray:
        ids = self.inner(ids)
        return self.pairs.of(before(ids, ends, self.start)[take], ids[take])

    @staticmethod
    def found(level: Level, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Level.find for keys in any order."""
        distinct, back = np.unique(keys, return_inverse=True)
        return tuple(x[back] for x in level.find(*level.keys.parts(distinct)))

    def trigram_keys(self, ids: np.ndarray, ends: np.ndarray, take=None) -> np.ndarray:
        """Keys of the trigrams of all tokens (or those at take) but each text's first."""
        keys = self.bigram_keys(ids, ends)
        first = np.zeros(len(ids), bool)
        first[np.concatenate([[0], ends[:-1]])[: len(ends)]] = True
        at = np.flatnonzero(~first) if take is None else take[~first[take]]
        if take is None:
            rank, _, _, begin = self.found(self.bigrams, keys)
            return self.triples.of(rank[at - 1], rank[at] - begin[at])
        rank, _, _, begin = self.found(self.bigrams, np.concatenate([keys[at - 1], keys[at]]))
        return self.triples.of(rank[: len(at)], rank[len(at) :] - begin[len(at) :])

    def logs(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrences, base log10, log10 by the model) of each token."""
        c = self.vocabulary.counts(ids)
        base = np.log10(c + DELTA) - np.log10(self.total + DELTA * (self.vocabulary.size + 1))
        inner = self.inner(ids)
        context = before(inner, ends, self.start)
        rank, own, weight, begin = self.found(self.bigrams, self.pairs.of(context, inner))
        rare, unknown = inner == self.rare, context == self.rare
        p = np.minimum(np.where(rare | unknown, 0, own) + np.where(unknown, 1, weight) * 10**base, 1.0)
        above = np.concatenate([[-1], rank[:-1]])[: len(rank)]
        above[np.concatenate([[0], ends[:-1]])[: len(ends)]] = -1
        on = np.flatnonzero(above >= 0)
        _, own, weight, _ = self.found(self.trigrams, self.triples.of(above[on], np.where(rank[on] >= 0, rank[on] - begin[on], self.bigrams.most)))
        p[on] = np.minimum(np.where(rare[on], 0, own) + weight * p[on], 1.0)
        return c, base, np.log10(p)


def train(docs: DataFrame, min_word: int = MIN_WORD) -> Model:
    """Count docs(text) and write the levels into the shared folder."""
    return trained(docs.withColumns({"doc_id": F.lit(0).cast("long"), "held_out": F.lit(False)}), min_word)[0]


def trained(docs: DataFrame, min_word: int = MIN_WORD) -> tuple[Model, DataFrame]:
    """The model of those of docs(doc_id, held_out, text) that are not held out, and the ids of all (see numbered)."""
    spark = docs.sparkSession
    bounded_batches(spark, BATCH_ROWS, BATCH_MB)
    path = fresh_path(spark, "lm")
    own = docs.where(~F.col("held_out"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, (-(-size // WORD_BYTES) - 1).bit_length())
    vocabulary, total = build_vocabulary(count_words(own, bits), bits, path)
    model = Model(vocabulary, total, min_word)
    numbers = stored(numbered(docs, vocabulary), "ids")
    own = numbers.where(~F.col("held_out"))

    def level(keys, keys_of, name):
        let_go(spark)
        cuts = ranges(own, keys, keys_of, total, model.wide)
        return build_level(counted(own, keys, keys_of, cuts, model.wide), keys, cuts, f"{path}/{name}")

    model.with_bigrams(level(model.pairs, model.bigram_keys, "bigrams"))
    model.trigrams = level(model.triples, model.trigram_keys, "trigrams")
    return model, numbers


def scored(numbers: DataFrame, model: Model) -> DataFrame:
    """numbers(doc_id, held_out, ids) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    bounded_batches(numbers.sparkSession, BATCH_ROWS, BATCH_MB)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for held, ids, ends in gathered(batches, 2, model.wide):
            if not len(ends):
                continue
            c, base, logs = model.logs(ids, ends)
            starts = np.concatenate([[0], ends[:-1]])
            per = [np.diff(ends, prepend=0), np.add.reduceat((c > 0).astype(np.int64), starts), np.full(len(ends), model.total), np.add.reduceat(base, starts), np.add.reduceat(logs, starts)]
            own = pa.Table.from_batches(held).combine_chunks()
            yield pa.RecordBatch.from_arrays([own.column(0).combine_chunks(), own.column(1).combine_chunks(), *map(pa.array, per)], names)

    return numbers.select("doc_id", "held_out", "ids").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, held_out, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return scored(numbered(docs, model.vocabulary), model)


def folded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, text): held out where crc32 of the id's text is 0 modulo FOLDS."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    return df.select(F.col(id_col).cast("long").alias("doc_id"), (fold == 0).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
