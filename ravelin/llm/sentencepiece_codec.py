"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the pair whose union has the best
score (leftmost on ties) merges first, and each merge offers its two new neighbours. Symbols that
stay outside the vocabulary fall back to their UTF-8 bytes.

Merges can never cross two characters that stand side by side in no piece, so a text is cut there
into independent parts. In ordinary vocabularies a blank's mark begins its word and line feeds stand
alone; a word between single blanks is then such a part, and a worker remembers the ids of the words
it has seen (at most CACHE_CHUNKS short ones, in two generations). Vocabularies without that
property, and texts with marks or repeated blanks, are cut character by character.
What is new in each Arrow batch, words and texts encoded as a whole, is checked against the sentencepiece library; a difference raises.

Null and empty texts give the end id alone and decode to the empty text. Repeated rows give
repeated results. Other columns are not read. A white-space mark U+2581 in a text decodes as a
blank, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ravelin.llm.common import bounded_batches, texts

MARK = "▁"
CACHE_CHUNKS = 500_000
LONG_CHUNK = 48
#: What stands before a line feed when its word is shown to the library.
FRONT = "a"
#: Rank of a pair whose union is no piece.
NO_PIECE = 1 << 62
#: Ids of remembered words, at most, before a batch.
MOST_IDS = 12 << 20
#: Words whose pieces are put together at a time.
GATHERED = 1 << 16

COLUMNS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "n_tokens": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


class Codec:
    """Encoder and decoder over one model file; one per worker process."""

    _loaded: dict[str, "Codec"] = {}

    @classmethod
    def of(cls, path: str) -> "Codec":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.id_of: dict[str, int] = {}
        score: dict[str, float] = {}
        self.eos = lib.eos_id()
        shown: list[bytes] = []
        for i in range(n):
            p = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                shown.append(bytes([int(p[3:5], 16)]))
            elif lib.is_control(i):
                shown.append(b"")
            elif lib.is_unknown(i):
                shown.append(" \u2047 ".encode())
            else:
                score[p], self.id_of[p] = lib.get_score(i), i
                shown.append(p.replace(MARK, " ").encode())
        self.blob = np.frombuffer(b"".join(shown), np.uint8)
        self.blob_ends = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        spelled = [b"%d " % i for i in range(n)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_ends = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
        self.silent = np.array([not x for x in shown])
        self.marked = np.array([lib.id_to_piece(i)[:1] == MARK for i in range(n)])
        order = {x: r for r, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in score.items()}
        #: Characters that stand side by side in some piece; merges cannot cross any other place.
        self.pairs = {p[i : i + 2] for p in score for i in range(len(p) - 1)}
        self.plain = not any("\n" in x or (x[1] == MARK and x[0] != MARK) for x in self.pairs)
        self.front = lib.encode(FRONT)
        self.parts: dict[str, list[int]] = {}
        self.words = Known(self)

    def agenda(self, s: str) -> list[int]:
        """The ids of one part. The agenda of a short part stands in text order, that of a longer one is a heap."""
        sym = self.merged_by_heap(s) if len(s) > LONG_CHUNK else self.merged_in_place(s)
        try:
            return [self.id_of[x] for x in sym]
        except KeyError:
            return [i for x in sym for i in ([self.id_of[x]] if x in self.id_of else [self.bytes[b] for b in x.encode()])]

    def merged_in_place(self, s: str) -> list[str]:
        """Symbols of a short part: the agenda holds the rank of the pair at each place; the least, then leftmost, is next."""
        rank = self.rank.get
        sym = list(s)
        agenda = [rank(x + y, NO_PIECE) for x, y in zip(sym, sym[1:])]
        while agenda and (best := min(agenda)) != NO_PIECE:
            i = agenda.index(best)
            p = sym[i] = sym[i] + sym.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(sym[i - 1] + p, NO_PIECE)
            if i < len(agenda):
                agenda[i] = rank(p + sym[i + 1], NO_PIECE)
        return sym

    def merged_by_heap(self, s: str) -> list[str]:
        """Symbols of a part of any length. An entry is a pair's rank by score, then its left place."""
        rank = self.rank.get
        sym: list[str | None] = list(s)
        n = len(sym)
        shift = n.bit_length()
        left_of = (1 << shift) - 1
        heap = [(r << shift) | i for i, (x, y) in enumerate(zip(sym, sym[1:])) if (r := rank(x + y)) is not None]
        heapq.heapify(heap)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            e = heapq.heappop(heap)
            a = e & left_of
            if sym[a] is None or (b := nxt[a]) >= n or rank(p := sym[a] + sym[b]) != e >> shift:
                continue  # a symbol of this pair has merged since
            sym[a], sym[b] = p, None
            c = nxt[a] = nxt[b]
            if c < n:
                prev[c] = a
                if (r := rank(p + sym[c])) is not None:
                    heapq.heappush(heap, (r << shift) | a)
            if (c := prev[a]) >= 0 and (r := rank(sym[c] + p)) is not None:
                heapq.heappush(heap, (r << shift) | c)
        return [x for x in sym if x is not None]

    def encode_chunk(self, s: str) -> list[int]:
        """The ids of a text with marks for blanks: one agenda if it is short; else it is cut where nothing can merge, one agenda for each part."""
        if len(s) <= LONG_CHUNK:
            return self.agenda(s)
        pairs, parts = self.pairs, self.parts
        cuts = [0, *[i for i, (x, y) in enumerate(zip(s, s[1:]), 1) if x + y not in pairs], len(s)]
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            part = s[a:b]
            ids = parts.get(part)
            if ids is None:
                ids = self.agenda(part)
                if b - a <= LONG_CHUNK:
                    if len(parts) >= CACHE_CHUNKS // 2:
                        parts.clear()
                    parts[part] = ids
            out += ids
        return out

    def check(self, new: list[tuple[str, list[int]]]) -> None:
        """Hold newly met words against the library, which adds one mark in front by itself."""
        for (word, out), ids in zip(new, self.lib.encode([w for w, _ in new], num_threads=1)):
            if ids != out:
                raise ValueError(f"encoding differs from the library's for {word!r}")

    def encode_batch(self, batch: list[str]) -> "Encoded":
        """Look up each blank-separated word; what is not so plain goes through encode_chunk as a whole."""
        words = self.words
        words.turn()
        places: list[int] = []
        ends: list[int] = []
        for text in batch:
            if text:
                split = text.replace("\n", " \n").split(" ")
                if MARK in text or "" in split or not self.plain:
                    whole = self.encode_chunk(MARK + text.replace(" ", MARK))
                    words.unchecked.append((text, whole))
                    places.append(words.add(whole))
                else:
                    places += [words[w] for w in split]
            places.append(0)
            ends.append(len(places))
        self.check(words.unchecked)
        words.unchecked = []
        return Encoded(self, np.array(places, dtype=np.int64), np.array(ends, dtype=np.int64))

    def encode_text(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        return self.encode_batch([text]).ids().tolist()

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids that ends at bounds, from the pieces' bytes."""
        ids = ids.astype(np.int64)
        flat = gathered(self.blob, self.blob_ends, ids).tobytes()
        to = np.concatenate([[0], np.cumsum(self.blob_ends[ids + 1] - self.blob_ends[ids])])
        shown = np.concatenate([[0], np.cumsum(~self.silent[ids])])
        out, a = [], 0
        for b in bounds.tolist():
            raw = flat[to[a] : to[b]]
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = replaced(raw)
            if raw[:1] == b" ":  # the mark that encoding has put in front, unless a byte or the unknown piece stands there
                first = int(ids[a + int(np.searchsorted(shown[a : b + 1], shown[a] + 1)) - 1])
                text = text[1:] if self.marked[first] else text
            out.append(text)
            a = b
        return out

    def decode_ids(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0]


class Known(dict):
    """Place of each known word in a flat array of ids; two generations."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old, self.unchecked = codec, {}, []
        self.start_over()

    def start_over(self) -> None:
        self.ids, self.id_ends = array("i"), array("q", [0])
        self.add([self.codec.eos])

    def turn(self) -> None:
        """Between batches: with a full young generation, the words go to the old one, which is forgotten."""
        if len(self) >= CACHE_CHUNKS or len(self.ids) > MOST_IDS:
            self.old = {w: self.ids[self.id_ends[k] : self.id_ends[k + 1]] for w, k in self.items()}
            self.clear()
            self.start_over()

    def add(self, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.id_ends.append(len(self.ids))
        return len(self.id_ends) - 2

    def __missing__(self, word: str) -> int:
        before = self.old.get(word)
        if before is not None:
            ids = before
        else:
            ids = self.codec.encode_chunk(word if word[0] == "\n" else MARK + word)
            # the library puts a mark in front of what it is given; nothing merges across a line feed
            self.unchecked.append((word, ids) if word[0] != "\n" else (FRONT + word, self.codec.front + ids))
        k = self.add(ids)
        if len(word) <= LONG_CHUNK:
            self[word] = k
        return k


class Encoded:
    """Ids of a batch of texts, one text after another."""

    def __init__(self, codec: Codec, places: np.ndarray, ends: np.ndarray):
        w = codec.words
        id_ends = np.frombuffer(w.id_ends, np.int64)
        self.codec = codec
        self._ids = gathered(np.frombuffer(w.ids, np.int32), id_ends, places)
        self._bounds = np.cumsum(id_ends[places + 1] - id_ends[places])[ends - 1]

    def ids(self) -> np.ndarray:
        return self._ids

    def id_bounds(self) -> np.ndarray:
        """End of each text in ids()."""
        return self._bounds

    def spelled(self) -> list[bytes]:
        """The decimal ids of each text, joined by blanks."""
        to = np.cumsum(np.diff(self.codec.spelled_ends)[self._ids])
        flat = gathered(self.codec.spelled, self.codec.spelled_ends, self._ids).tobytes()
        ends = to[self._bounds - 1].tolist()
        return [flat[a : b - 1] for a, b in zip([0, *ends], ends)]


def gathered(flat: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The pieces ends[p]..ends[p + 1] of flat, one after another."""
    parts = [flat[:0]]
    for at in range(0, len(places), GATHERED):
        p = places[at : at + GATHERED]
        size = ends[p + 1] - ends[p]
        to = np.cumsum(size)
        parts.append(flat[np.repeat(ends[p] - to + size, size) + np.arange(to[-1])])
    return np.concatenate(parts)


def replaced(run: bytes) -> str:
    """UTF-8 with U+FFFD for every byte that belongs to no character."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            i += 1
    return "".join(out)


def apply(df: DataFrame, model_path: str, outputs: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the wanted outputs (see COLUMNS) and the columns keep of every row, by one narrow pass."""
    bounded_batches(df.sparkSession, mb=8)
    types = {k: COLUMNS[k][1] for k in outputs}

    def run(batches):
        codec = Codec.of(model_path)
        for batch in batches:
            made: dict[str, list] = {}
            encoded = codec.encode_batch(batch.column(1).to_pylist())
            ids, bounds = encoded.ids(), encoded.id_bounds()
            sizes = np.diff(bounds, prepend=0)
            if "ids" in outputs:
                made["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], bounds]), pa.int32()), pa.array(ids))
            if "n_tokens" in outputs:
                made["n_tokens"] = pa.array(sizes)
            if "ids_sha256" in outputs:
                made["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in encoded.spelled()]
            if "decoded" in outputs or "decoded_sha256" in outputs:
                made["decoded"] = codec.decode_batch(ids, bounds)
                if "decoded_sha256" in outputs:
                    made["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in made["decoded"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(made[k] if isinstance(made[k], pa.Array) else pa.array(made[k], types[k]) for k in outputs), *batch.columns[2:]], ["doc_id", *outputs, *keep])

    kept = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    return texts(df, id_col, text_col, keep).mapInArrow(run, ", ".join(["doc_id long", *(f"{k} {COLUMNS[k][0]}" for k in outputs), *kept]))
