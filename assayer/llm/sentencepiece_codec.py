"""SentencePiece encoding and decoding by a Viterbi pass that words share.

A text is cut into marked words: no piece of the vocabulary goes on after a space mark, and a character
outside the vocabulary never merges. The distinct new words of a batch are sorted, which lays out their
trie, and walked depth-first: a node's forward state is the last piece of its prefix's best path, so a
word goes on from the prefix that it shares with the word before, and a word's ids are read off by going
back from its end. That is one number a character, however long a word is. The path model is first-order: a
step from piece a to piece b scores 0 if the merges leave a + b as these two pieces, else minus infinity;
a path of finite score is the one that byte-pair merging makes. Words that begin with several marks,
whose merges tie, are merged one by one, by a heap; so is a word that no path reaches.

A worker remembers words up to ``CACHE_BYTES`` and empties that when a task ends; words of over
``LONG_WORD`` characters are forgotten after their block, which has ``BLOCK`` characters or one text.

Edge cases: a null or empty text has no ids; texts and words of any length are read whole, in time and
memory that grow with their length; characters outside the vocabulary become byte pieces;
repeated rows are encoded each; an empty table gives an empty result; other columns are ignored, whatever
their names. Decoding undoes the marks; unknown ids give U+2047 between spaces, as the library does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._common import in_arrow, prepare, table

MARK = "▁"
#: Bytes of words that a worker remembers, what one takes besides its text and ids, and pairs of pieces (about 120 bytes each).
CACHE_BYTES, ENTRY_BYTES, PAIRS = 64 << 20, 190, 400_000
LONG_WORD, BLOCK = 256, 1 << 21
#: Characters outside the vocabulary have numbers from here on, beyond those of the pieces.
OTHER = 1 << 24
RESULT = "doc_id long, n_ids long, ids array<int>, round_trip boolean"
_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class Codec:
    """Encoder and decoder of a byte-pair model file without character normalisation."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or any(p.type == USER for p in model.pieces):
            raise ValueError("only byte-pair models with a dummy prefix, without normalisation or user-defined pieces")
        self.limit = limit
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece goes on after a space mark")
        self.halves: dict[str, tuple[str, str] | None] = {}
        #: Numbers of the pieces that merging makes, which are their ids, and of other characters as they come.
        self.coded = {p: i for p, (i, _) in self.pieces.items() if len(p) == 1 or self.split(p)}
        self.name = {i: p for p, i in self.coded.items()}
        self.code = {i: np.array([i], "<i4").tobytes() for i in self.name}
        found: dict[str, set[int]] = {}
        for p in self.coded:
            found.setdefault(p[-4:], set()).add(len(p))
        #: By the last four characters, the lengths of pieces that end so, longest first.
        self.lengths = {k: tuple(sorted(v | {1, 2, 3}, reverse=True)) for k, v in found.items()}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        surface = {NORMAL: lambda p: p.piece.replace(MARK, " ").encode(), BYTE: lambda p: bytes([int(p.piece[1:-1], 16)]), UNKNOWN: lambda p: " ⁇ ".encode()}
        self.surface = [surface.get(p.type, lambda p: b"")(p) for p in model.pieces]
        self.words: dict[str, bytes] = {}
        self.size = 0
        self.long: list[str] = []
        self.pairs: dict[int, bool] = {}

    # -- merging one string

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging: the best-scored neighbours first, the leftmost of equal ones."""
        parts: list[str] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                found = self.pieces.get(parts[i] + parts[after[i]])
                if found:
                    heappush(heap, (-found[1], i, parts[i], parts[after[i]]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, x, y = heappop(heap)
            j = after[i]
            if parts[i] != x or j >= len(parts) or parts[j] != y:
                continue  # one of the two is part of another piece by now
            parts[i], parts[j] = x + y, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; None for a character, or a piece that merging does not make."""
        if piece not in self.halves:
            parts, before = list(piece), None
            while len(parts) > 1:
                found = [(self.pieces[x + y][1], -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.pieces]
                if not found:
                    before = None
                    break
                at = -max(found)[1]
                before = (parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[piece] = before
        return self.halves[piece]

    def step(self, a_number: int, b_number: int) -> bool:
        """Whether a path may go from piece a to piece b (given by their numbers).

        Goes back in time from the two pieces: the later of the two merges is undone, which leaves other
        neighbours at the border. Had these a merge of their own that comes before the undone one, the
        border would have been merged away.
        """
        key = a_number << 25 | b_number
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.name[a_number], self.name[b_number]
            until, right = -np.inf, False  # scores fall with time: a merge comes earlier if its score is higher, or equal and further left
            while True:
                both = self.pieces.get(a + b)
                if both and (both[1] > until or right and both[1] == until):
                    found = False
                    break
                x, y = self.split(a), self.split(b)
                if not x and not y:
                    found = True
                    break
                if x and (not y or self.pieces[a][1] < self.pieces[b][1]):
                    until, a, right = self.pieces[a][1], x[1], False
                else:
                    until, b, right = self.pieces[b][1], y[0], True
            self.pairs[key] = found
        return found

    # -- the shared pass

    def paths(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each of the sorted words. ``last[i]`` is the number of the last piece of the best path to prefix i; what a word shares with the one before is kept."""
        last, before = [0], ""
        coded, lengths, pairs, code, name = self.coded, self.lengths, self.pairs, self.code, self.name
        for word in words:
            shared, most = 0, min(len(before), len(word), len(last) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                for n in lengths.get(word[i - 4 if i > 4 else 0 : i], (3, 2, 1)):
                    start = i - n
                    if start < 0:
                        continue
                    piece = coded.get(word[start:i])
                    if piece is None:
                        if n > 1:
                            continue
                        piece = self.character(word[start:i])
                    if start:
                        good = pairs.get(last[start] << 25 | piece)
                        if not (self.step(last[start], piece) if good is None else good):
                            continue
                    last.append(piece)
                    break
                else:
                    break
            before = word
            if len(last) <= len(word):
                yield self.ids(self.merge(word))
                continue
            i, out = len(word), []
            while i:
                out.append(code[last[i]])
                i -= len(name[last[i]])
            out.reverse()
            yield b"".join(out)

    def character(self, c: str) -> int:
        """The number of a character outside the vocabulary."""
        number = OTHER + ord(c)
        if number not in self.code:
            self.name[number] = c
            self.code[number] = np.array([self.bytes.get(x, self.unknown) for x in c.encode("utf-8", "replace")] if self.bytes else [self.unknown], "<i4").tobytes()
        return number

    def ids(self, pieces: list[str]) -> bytes:
        return b"".join(self.code[self.coded[p] if p in self.coded else self.character(p)] for p in pieces)

    def add(self, units: set[str]) -> None:
        """Encodes the units that are not remembered yet."""
        for unit in self.long:
            del self.words[unit]
        self.long = []
        if self.size > self.limit:
            self.forget()
        new = sorted(u for u in units if u not in self.words)
        plain = [u for u in new if not u.startswith(MARK * 2)]
        found = dict(zip(plain, self.paths(plain), strict=True))
        for unit in new:
            if unit.startswith(MARK * 2):
                found[unit] = self.ids(self.merge(unit))
        self.words.update(found)
        self.long = [u for u in new if len(u) > LONG_WORD]
        self.size += sum(ENTRY_BYTES + len(u) + len(x) for u, x in found.items() if len(u) <= LONG_WORD)

    def forget(self) -> None:
        self.words, self.long, self.size = {}, [], 0

    def units(self, text: str) -> list[str]:
        return _UNITS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            block, size = [], 0
            while at < len(texts) and (not block or size < BLOCK):
                block.append(self.units(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            self.add(set().union(*block))
            out += [b"".join(map(self.words.__getitem__, own)) for own in block]
        return out

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _lists(blobs: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(blobs) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in blobs], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        try:
            for b in batches:
                texts = b.column(1).to_pylist()
                blobs = own.encode(texts)
                back = [own.decode(np.frombuffer(x, "<i4")) == (t or "") for x, t in zip(blobs, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in blobs], pa.int64()), _lists(blobs), pa.array(back, pa.bool_())], names=["doc_id", "n_ids", "ids", "round_trip"])
        finally:
            own.forget()

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts = [own.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def model_path(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids, and whether decoding the ids gives the text back."""
    prepare(docs.sparkSession)
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _encode(model_path(path)), RESULT)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text."""
    prepare(encoded.sparkSession)
    return in_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), _decode(model_path(path)), "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every row of ``documents``, and whether they give its text back."""
    return encode_documents(table(spark, sf_dir, "documents"))
