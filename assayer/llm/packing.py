"""Best-fit packing of tokenised documents into fixed-length sequences (length-histogram planning).

The plan is made over counts of lengths, never over documents: there are at most ``capacity`` lengths,
so histogram and plan are small whatever the corpus. Best-fit decreasing runs on groups of equal bins:
a group of ``bins`` sequences with the same room takes the next length at once. Each placement is one
plan row; documents then take their slot by joining on their rank within their length.

Workers hold at most ``CACHE_BYTES`` of words besides a block's own; ``KEPT`` short ones outlive a task.

Edge cases: a null text is an empty one (one end token); repeated rows are packed once each; ties in a
length are ranked by doc_id, piece and checksum; texts of any length are read whole, in
words, and cut only into pieces; an empty table gives an empty result; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Collection, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm._common import Store, in_arrow, partitions, prepare, table, utf8

CAPACITY = 4096
#: Id that closes every document.
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

#: Most plan rows that are broadcast; a longer plan is joined by shuffle.
BROADCAST_ROWS = 100_000


#: Marks that end words; none of them begins a contraction or a special token.
MARKS = b".,!?%*#$&;:)|"
#: Bytes that a worker's cache of words may take, and what an entry takes besides its word and ids.
CACHE_BYTES, ENTRY_BYTES = 80 << 20, 176
#: Length of short words, and how many of them outlive a task.
SHORT, KEPT = 9, 50_000


#: Letters that normalisation leaves alone, but for case.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def plain_letters(word: str) -> bool:
    """Whether a word is nothing but letters after the vocabulary's normalisation. (U+0130 is not: its lower case is two characters.)"""
    return bool(_LATIN(word)) or word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha()


class WordIds:
    """Word -> its ids as little-endian bytes. White space always separates tokens of this vocabulary
    (its pattern never matches any), so a text's ids are those of its words, one after another. Words of
    letters, with marks at the end, take the ids of their letters in lower case: case and marks do not
    change them, and one call encodes many, as every such token ends in a piece that closes a word. For
    ASCII letters the model alone does, since normalisation and byte mapping leave them as they are.

    Words are held in two generations of at most half of ``limit`` bytes each: when the newer one is full
    it becomes the older, and a word of the older one that comes again moves back. A block's own words are
    held beyond that."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.limit, self.tokenizer = limit, Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0
        self.marks: dict[bytes, bytes] = {b"": b""}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def encode(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def hold(self, words: Collection[bytes], ids: list[bytes]) -> None:
        self.ids.update(zip(words, ids, strict=True))
        self.size += len(words) * ENTRY_BYTES + sum(map(len, words)) + sum(map(len, ids))

    def add_letters(self, new: list[bytes], tokenizer) -> None:
        for at in range(0, len(new), 256):
            part = new[at : at + 256]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) == len(part):
                buf = ids.tobytes()
                self.hold(part, list(map(buf.__getitem__, map(slice, [0, *ends], ends))))
            else:
                self.hold(part, self.encode(part))

    def add(self, words: set[bytes]) -> None:
        if self.size > self.limit // 2:
            self.old, self.ids, self.size = self.ids, {}, 0
        new = self.missing(words)
        stems = [w.lower().rstrip(MARKS) for w in new]
        distinct = set(stems)
        letters = {w for w in distinct if w.isalpha()}
        wide = {w for w in distinct.difference(letters) if not w.isascii() and plain_letters(w.decode())}
        self.add_letters(list(self.missing(letters)), self.bare)
        self.add_letters(list(self.missing(wide)), self.tokenizer)
        letters |= wide
        known, ids, other = [], [], []
        for word, stem in zip(new, stems, strict=True):
            if stem not in letters:
                other.append(word)
            elif word != stem:
                mark = word[len(stem) :]
                end = self.marks.get(mark)
                if end is None:
                    if len(self.marks) > 10_000 or len(mark) > 64:
                        other.append(word)
                        continue
                    end = self.marks[mark] = self.encode([mark])[0]
                known.append(word)
                ids.append(self.ids[stem] + end)
        self.hold(known, ids)
        self.hold(other, self.encode(other))

    def missing(self, words: set[bytes]) -> set[bytes]:
        """The words that neither generation holds; those of the older one move back."""
        left, old = words.difference(self.ids), self.old
        again = [w for w in left if w in old] if old else []
        self.hold(again, list(map(old.__getitem__, again)))
        return left.difference(again)

    def forget(self) -> None:
        """Empties both generations but for some short words, which are the frequent ones."""
        self.ids = dict(islice(((w, x) for w, x in chain(self.old.items(), self.ids.items()) if len(w) <= SHORT), KEPT))
        self.old, self.size = {}, len(self.ids) * (ENTRY_BYTES + 2 * SHORT)


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def encoded(texts: list[str | None], ids: WordIds) -> Iterator[bytes]:
    """Ids of each text with the end id, as little-endian bytes. Texts are taken in blocks of limited size."""
    end = np.array([END_ID], "<u4").tobytes()
    at = 0
    while at < len(texts):
        block, size = [], 0
        while at < len(texts) and (not block or size < 1 << 20):
            block.append(utf8(texts[at]).split())
            size += len(texts[at] or "")
            at += 1
        words = set().union(*block)
        ids.add(words)
        del words
        get = ids.ids.__getitem__
        for own in block:
            yield b"".join(map(get, own)) + end


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        try:
            for b in batches:
                out: list[list] = [[], [], [], [], []]
                for doc_id, buf in zip(b.column(0).to_pylist(), encoded(b.column(1).to_pylist(), ids), strict=True):
                    for piece, at in enumerate(range(0, len(buf), 4 * capacity)):
                        part = buf[at : at + 4 * capacity]
                        for c, v in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)
        finally:
            ids.forget()

    return run


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""
    prepare(docs.sparkSession)
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _pieces(path, capacity), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, first, n, per_bin, sequence, offset): the items of
    ``length`` ranked first .. first + n - 1 go to sequences from ``sequence`` on, ``per_bin`` in each
    from ``offset`` on.

    Each length fills the groups of least room first, and each group is full of it before the next, as
    best fit does with single items; a group that is not used up is split in two.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted rooms that have groups
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, bins)
    opened = 0

    def put(room: int, sequence: int, bins: int) -> None:
        if room and bins:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((sequence, bins))

    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                sequence, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, sequence = capacity, opened
                bins = -(-left // (capacity // length))
                opened += bins
            each = room // length
            n = min(left, each * bins)
            rows.append((length, first, n, each, sequence, capacity - room))
            full, rest = divmod(n, each)
            put(room - each * length, sequence, full)
            if rest:
                put(room - rest * length, sequence + full, 1)
            put(room, sequence + full + bool(rest), bins - full - bool(rest))
            left -= n
            first += n
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    A rank within a length is a rank within (length, salt) plus the count of the salts before: a length
    that holds most documents is ranked by many tasks. ``pieces`` is read more than once: give a
    written table.
    """
    spark = pieces.sparkSession
    salts = 4 * partitions(spark)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    cells = pieces.groupBy("length", "salt").count()
    per_length = cells.groupBy("length").agg(F.sum("count").alias("n"))
    counts = {r["length"]: r["n"] for r in per_length.collect()}  # at most ``capacity`` rows
    rows = plan(counts, capacity)
    slots = spark.createDataFrame(rows, "length long, first long, n long, per_bin long, sequence long, at long") if rows else spark.createDataFrame([], "length long, first long, n long, per_bin long, sequence long, at long")
    before = cells.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    if len(rows) <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    p, s = ranked.alias("p"), slots.alias("s")
    rel = F.col("p.rank") - F.col("s.first")
    return p.join(s, (F.col("p.length") == F.col("s.length")) & (F.col("p.rank") >= F.col("s.first")) & (F.col("p.rank") < F.col("s.first") + F.col("s.n"))).select(
        "p.doc_id",
        "p.piece",
        "p.start",
        "p.length",
        "p.ids_crc32",
        (F.col("s.sequence") + F.floor(rel / F.col("s.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + F.pmod(rel, F.col("s.per_bin")) * F.col("p.length")).cast("long").alias("offset"),
    )


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises and packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(Store(docs.sparkSession).keep(tokenized_pieces(docs, path, capacity)), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every row of ``documents``, packed into sequences."""
    return best_fit_packing(table(spark, sf_dir, "documents"))
