"""SentencePiece encoding and decoding by a streaming Viterbi pass.

Text becomes symbols: a mark for each space, one more before the first, and each character that no piece has as its UTF-8
bytes. The pass reads characters in order. At each position it keeps, for every piece that may end there, the best path to
it, and looks no further back than the longest piece. As soon as all paths that are still alive go through one boundary,
the ids before it are committed and forgotten, so memory does not follow the length of the text.

What "best" means is the model's type:

* unigram models: the greatest sum of piece scores, the usual Viterbi recursion;
* BPE models: the path that merging by rank gives. A sequence of pieces is the result of merging if and only if each pair
  of neighbours is, so a state is the last piece, and a step from one piece to the next is alive if merging their joined
  text gives these two again. For a prefix exactly one state is the result of merging it, so each position has one back
  pointer. (A Viterbi maximum of BPE scores, which are ranks, is not what the library returns.)

Where a mark follows another character no piece reaches across, so all paths meet there and words can be remembered.

Defined results: a null or empty text has no ids; any text, also one long word, is encoded whole; decoding returns the
text unless it holds what the model's normalisation changes; rows that repeat are encoded each; an empty table gives an
empty result; other columns of the input are not read. A null id stays null.
"""

from __future__ import annotations

import array
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import slices
from tessera.llm.shingles import texts_of
from tessera.llm.wordcodec import remembered

MARK = "▁"
#: Bytes of words and ids that a worker remembers, and about how many an entry takes.
CACHE_BYTES, ENTRY_BYTES = 288 << 20, 240
CACHE_WORDS = CACHE_BYTES // ENTRY_BYTES
#: Before each mark that follows another character.
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


#: In place of ids: before the first piece, and a character that no piece has. Neither merges with anything.
_FIRST, _NO_PIECE = -2, -1
#: Under what a trie's node holds the id of the piece that ends there.
_END = ""


class Vocabulary:
    """The pieces of a model file, and which pairs of them may be neighbours."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.unknown = m.unk_id()
        self.byte_ids = {}
        self.pieces: dict[str, int] = {}
        self.strings = [m.id_to_piece(i) for i in range(n)]
        for i, p in enumerate(self.strings):
            if m.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.pieces[p] = i
        self.score = [m.get_score(i) for i in range(n)]
        self.longest = max(map(len, self.pieces), default=1)
        self.lowest = min(self.score, default=0.0)
        self.bpe = model_type(path) == "bpe"
        self.crosses = any(MARK in p.lstrip(MARK) for p in self.pieces)
        self._pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merging by rank, leftmost first; only for short texts, to decide which pairs may be neighbours."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.pieces.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces gives them again; what no piece has is next to anything."""
        if a < 0 or b < 0:
            return True
        found = self._pairs.get(a << 20 | b)
        if found is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            x, y = self.strings[a], self.strings[b]
            found = self._pairs[a << 20 | b] = self.merged(x + y) == [x, y]
        return found

    @functools.cached_property
    def whole(self) -> dict[str, int]:
        """Pieces that merging gives from their own characters."""
        return {p: i for p, i in self.pieces.items() if len(p) == 1 or self.merged(p) == [p]}


    @functools.cached_property
    def endings(self) -> dict:
        """A trie of the pieces that may be on a path, from their last character to the first; a node holds its piece under ``_END``."""
        root: dict = {}
        for p, k in (self.whole if self.bpe else self.pieces).items():
            node = root
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[_END] = k
        return root


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, data[at : at + size]
        at += size


def model_type(path: str) -> str:
    """As the file's trainer specification (field 2) says in its field 3; unigram, the format's default, without one."""
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 2:
            kind = next((v for n, v in _fields(value) if n == 3), 1)
            return {1: "unigram", 2: "bpe", 3: "word", 4: "char"}[kind]
    return "unigram"


class Stream:
    """Encodes characters as they come; ``feed`` and ``close`` return the ids that are settled."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.text: list[str] = []  # characters that are not committed
        #: For each boundary of the window the best path's last piece: where it begins, its id, and the path's score.
        self.back: list[tuple[int, int, float] | None] = [(0, _FIRST, 0.0)]

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        text, back, v = self.text, self.back, self.v
        endings, window, step = v.endings, 2 * v.longest, self._merging if v.bpe else self._greatest
        n = len(text)
        for c in chars:
            text.append(c)
            n += 1
            node, i, found = endings, n, []
            while i:
                node = node.get(text[i - 1])
                if node is None:
                    break
                i -= 1
                k = node.get(_END)
                if k is not None and back[i] is not None:
                    found.append((i, k))
            if back[n - 1] is not None and (not found or found[0][0] != n - 1):
                found.insert(0, (n - 1, _NO_PIECE))
            back.append(step(found))
            if n > window:
                out += self._commit()
                text, back = self.text, self.back
                n = len(text)
        return out

    def _merging(self, found: list[tuple[int, int]]) -> tuple[int, int, float] | None:
        """The longest piece that may follow the one before it: for a prefix there is one."""
        pairs, back = self.v._pairs, self.back
        for i, k in reversed(found):
            before = back[i][1]
            if before < 0 or k < 0:
                return i, k, 0.0
            ok = pairs.get(before << 20 | k)
            if ok or (ok is None and self.v.neighbours(before, k)):
                return i, k, 0.0
        return None

    def _greatest(self, found: list[tuple[int, int]]) -> tuple[int, int, float] | None:
        best = None
        for i, k in reversed(found):
            s = self.back[i][2] + (self.v.score[k] if k >= 0 else self.v.lowest - 10.0)
            if best is None or s > best[2]:
                best = i, k, s
        return best

    def close(self) -> list[int]:
        out = self._ids(self._path(len(self.text)))
        self._reset()
        return out

    def _path(self, at: int) -> list[int]:
        cuts = [at]
        while at:
            at = self.back[at][0]
            cuts.append(at)
        return cuts[::-1]

    def _commit(self) -> list[int]:
        """Gives out what lies before the last boundary that all live paths share."""
        n = len(self.text)
        paths = [set(self._path(i)) for i in range(max(0, n - self.v.longest + 1), n + 1) if self.back[i] is not None]
        at = max(set.intersection(*paths))
        if not at:
            return []
        out = self._ids([c for c in self._path(n) if c <= at])
        last, score = self.back[at][1], self.back[at][2]
        self.text = self.text[at:]
        self.back = [(0, last, 0.0), *(x and (x[0] - at, x[1], x[2] - score) if x is None or x[0] >= at else None for x in self.back[at + 1 :])]
        return out

    def _ids(self, cuts: list[int]) -> list[int]:
        v, out = self.v, []
        for i, j in zip(cuts, cuts[1:], strict=False):
            k = self.back[j][1]
            if k >= 0:
                out.append(k)
            elif v.byte_ids:
                out += [v.byte_ids[b] for b in "".join(self.text[i:j]).encode()]
            elif not out or out[-1] != v.unknown:
                out.append(v.unknown)
        return out


class Codec:
    """Encodes and decodes whole texts for one worker."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.known: dict[str, bytes] = {}
        self._stream = Stream(self.v)
        spec = self.v.library
        self.prefix = bool(spec.encode("a") and spec.decode(spec.encode("a")) == "a" and spec.id_to_piece(spec.encode("a")[0]).startswith(MARK))

    def _word(self, word: str) -> bytes:
        s = self._stream
        return array.array("I", s.feed(word) + s.close()).tobytes()

    def _from_stem(self, word: str, new: dict[str, bytes]) -> bytes | None:
        """The ids of a word that is another and a full stop or comma, where its last piece and that may be neighbours."""
        v, last = self.v, word[-1:]
        if not v.bpe or last not in (".", ",") or last not in v.pieces or len(word) < 3:
            return None
        stem = word[:-1]
        ids = self.known.get(stem) or new.get(stem)
        if ids is None:
            if not stem[-1:].isalpha():
                return None
            ids = new[stem] = self._word(stem)
        end = int.from_bytes(ids[-4:], "little")
        if v.strings[end] not in v.pieces or not v.neighbours(end, v.pieces[last]):
            return None
        return ids + v.pieces[last].to_bytes(4, "little")

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if self.v.crosses:
            return self._word(marked)
        words, known = _WORDS.findall(marked), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        new: dict[str, bytes] = {}
        for w in set(words).difference(known):
            new[w] = self._from_stem(w, new) or self._word(w)
        if len(known) + len(new) <= CACHE_WORDS:
            known.update((w, b) for w, b in new.items() if len(w) <= 64)
        return b"".join(known.get(w) or new[w] for w in words)

    @functools.cached_property
    def _bytes(self) -> list[bytes]:
        """What each id adds to a text."""
        m, out = self.v.library, []
        for i, p in enumerate(self.v.strings):
            if m.is_byte(i):
                out.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i):
                out.append(b"")
            else:
                out.append(" ⁇ ".encode() if i == self.v.unknown else p.replace(MARK, " ").encode())
        return out

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (data[1:] if self.prefix and data[:1] == b" " else data).decode("utf-8", "replace")


@remembered
def worker_codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int)."""
    dtype = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [np.frombuffer(codec.encode(t), np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return _plain(docs, id_col, text_col).mapInArrow(run, f"doc_id {dtype}, ids array<int>")


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text; null ids are null text."""
    dtype = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {dtype}, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 of the ids as little-endian unsigned 32-bit numbers, round_trip: whether decoding gives the text again."""
    dtype = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            n, crc, same = [], [], []
            for text in texts_of(batch, 1):
                ids = codec.encode(text)
                n.append(len(ids) >> 2)
                crc.append(zlib.crc32(ids))
                same.append(codec.decode(ids) == (text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return _plain(docs, id_col, text_col).mapInArrow(run, f"doc_id {dtype}, n_ids long, ids_crc32 long, round_trip boolean")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
