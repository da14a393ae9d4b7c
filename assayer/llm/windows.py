"""Packing of tokenised documents in their order, by dynamic programming over window cuts.

The documents of a task follow each other in one stream of tokens, which is cut into windows of at most ``capacity``
tokens. A window may end at a document's end for nothing, at a sentence's end inside a document for ``SENTENCE``, and, where
a text has no sentence end for ``GAP`` tokens, at a stride of ``GAP / 2`` for ``FREE``. A window is padded to ``capacity``
unless its length is a power of two. The cheapest cuts satisfy

    cost(j) = penalty(j) + min(min over i in [j - capacity, j) of cost(i) + capacity - (j - i), min over k of cost(j - 2^k))

whose first part is a minimum of cost(i) + i over a sliding range: a monotone queue gives it in constant time. The
second part has at most twelve terms, looked up for all places at once.

A task holds about ``RUN`` tokens: they are solved, all windows but the last ``HELD`` are given out, and the held
ones' tokens are cut again with what follows, so no window ends early because a run does. Nothing is shuffled: windows
are made where the documents are read, and a task leaves one padded window at most at its end.

Edge cases: a null text is an empty one (one end token); repeated rows are packed once each; of equal costs the longest
last window is taken; a text of any length is read whole, a slice of ``LONG`` bytes after another; an empty table gives
an empty result; null doc_ids stay null; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._common import in_arrow, prepare, table
from assayer.llm.packing import END_ID, WordIds, word_ids

CAPACITY = 2048
#: What a cut inside a document costs, in tokens of padding: at a sentence's end, elsewhere.
SENTENCE, FREE = 8, 64
#: Tokens without a sentence end from which on cuts elsewhere are allowed.
GAP = 256
#: Tokens that are solved together, and windows at their end that are solved again with the next ones.
RUN, HELD = 1 << 20, 8
#: Bytes of a text that are split into words at once, and of texts whose words are looked up together.
LONG, TOGETHER = 1 << 20, 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])

_MARKS = frozenset(".!?")


def sentence_ends(ids: WordIds) -> np.ndarray:
    """Of each id of the vocabulary whether it closes a sentence: a word end of marks only, one of them a full stop or the like."""
    out = np.zeros(len(ids.closes), bool)
    for token, i in ids.tokenizer.get_vocab(with_added_tokens=False).items():
        marks = token.removesuffix("</w>")
        out[i] = not _MARKS.isdisjoint(marks) and marks.isascii() and not any(c.isalnum() for c in marks)
    return out & ids.closes


def places(ids: np.ndarray, doc_ends: np.ndarray, closing: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may be cut, and what each cut costs. The first place is 0, the last the stream's end."""
    gap = min(GAP, capacity)
    step = max(1, gap // 2)
    inner = np.setdiff1d(np.flatnonzero(closing.take(ids)) + 1, doc_ends, assume_unique=True)
    at = np.concatenate([[0], doc_ends, inner])
    cost = np.repeat(np.array([0, SENTENCE], np.int32), [len(doc_ends) + 1, len(inner)])
    order = np.argsort(at, kind="stable")
    at, cost = at[order], cost[order]
    wide = np.flatnonzero(np.diff(at) > gap)
    if len(wide):
        more = np.concatenate([np.arange(x + step, y, step) for x, y in zip(at[wide].tolist(), at[wide + 1].tolist(), strict=True)])
        order = np.argsort(np.concatenate([at, more]), kind="stable")
        at, cost = np.concatenate([at, more])[order], np.concatenate([cost, np.full(len(more), FREE, np.int32)])[order]
    return at, cost


def cut(at: np.ndarray, cost: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Indices of the places in ``at`` at which the cheapest windows end."""
    n = len(at)
    where = np.full(int(at[-1]) + 1, -1, np.int32)
    where[at] = np.arange(n)
    pairs = []
    for k in range(capacity.bit_length()):
        if 1 << k <= capacity:
            j = np.flatnonzero(at >= 1 << k)
            i = where[at[j] - (1 << k)]
            pairs.append(np.stack([j[i >= 0], i[i >= 0]]))
    exact = np.concatenate(pairs, axis=1)
    exact = exact[:, np.argsort(exact[0], kind="stable")]
    first = np.searchsorted(exact[0], np.arange(n + 1)).tolist()
    sources = exact[1].tolist()
    position, penalty = at.tolist(), cost.tolist()
    best, level, back = [0] * n, [0] * n, [0] * n  # level: cost(i) + i
    queue, head = [0], 0
    front = 0  # place of the queue's first entry
    for j, (p, more, a, b) in enumerate(zip(position[1:], penalty[1:], first[1:n], first[2:], strict=True), 1):
        while front < p - capacity:
            head += 1
            front = position[queue[head]]
        i = queue[head]
        least = level[i] + capacity - p
        if a != b:
            for s in sources[a:b]:
                if best[s] < least or best[s] == least and s < i:
                    least, i = best[s], s
        least += more
        best[j], back[j] = least, i
        own = level[j] = least + p
        while len(queue) > head and level[queue[-1]] > own:
            queue.pop()
        queue.append(j)
        front = position[queue[head]]
    ends, j = [], n - 1
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


class Stream:
    """Tokens of consecutive documents that no window has taken yet."""

    def __init__(self, closing: np.ndarray, capacity: int, first_sequence: int):
        self.closing, self.capacity, self.sequence = closing, capacity, first_sequence
        self.docs: list[tuple[int | None, int, int, bytes]] = []  # doc_id, doc_tokens, start, what is left of the ids
        self.tokens = 0

    def add(self, doc_id: int | None, buf: bytes) -> None:
        self.docs.append((doc_id, len(buf) // 4, 0, buf))
        self.tokens += len(buf) // 4

    def windows(self, held: int = HELD) -> pa.RecordBatch:
        """Pieces of the windows of what is there, but for the last ``held`` ones."""
        data = b"".join(d[3] for d in self.docs)
        ids = np.frombuffer(data, "<u4")
        ends = np.cumsum([len(d[3]) // 4 for d in self.docs])
        at, cost = places(ids, ends, self.closing, self.capacity)
        stops = at[cut(at, cost, self.capacity)]
        stops = stops[: max(len(stops) - held, 0)]
        done = int(stops[-1]) if len(stops) else 0
        begins = np.concatenate([[0], stops])
        marks = np.union1d(begins, ends[ends < done])  # where pieces begin, and the end
        lo, hi = marks[:-1], marks[1:]
        doc = np.searchsorted(ends, lo, "right")
        window = np.searchsorted(begins, lo, "right") - 1
        own = np.concatenate([[0], ends])[doc]
        start = np.array([d[2] for d in self.docs], np.int64)
        total = np.array([d[1] for d in self.docs], np.int64)
        view = memoryview(data)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[i][0] for i in doc.tolist()], pa.int64()),
                pa.array(start[doc] + lo - own),
                pa.array(hi - lo),
                pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.int64()),
                pa.array(total[doc]),
                pa.array(self.sequence + window),
                pa.array(lo - begins[window]),
            ],
            schema=_SCHEMA,
        )
        self.sequence += len(stops)
        left = int(np.searchsorted(ends, done, "right"))
        used = done - (int(ends[left - 1]) if left else 0)  # of the first document that is left
        self.docs = self.docs[left:]
        if self.docs and used:
            doc_id, n, begin, buf = self.docs[0]
            self.docs[0] = (doc_id, n, begin + used, buf[4 * used :])
        self.tokens -= done
        return out


def slices(text: bytes, size: int = LONG) -> Iterator[bytes]:
    """A text in parts that end at a space or line end."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] not in b" \n\t\r":
            end += 1
        yield text[at:end]
        at = end


def encoded(texts: list[bytes], ids: WordIds) -> Iterator[bytes]:
    """Ids of each text with the end id, as little-endian bytes; the words of all texts are looked up together."""
    block = [t.split() for t in texts]
    ids.add(set().union(*block))
    get, end = ids.ids.__getitem__, np.array([END_ID], "<u4").tobytes()
    for own in block:
        yield b"".join(map(get, own)) + end


def ids_of(texts: list[bytes], ids: WordIds) -> Iterator[bytes]:
    """Ids of each text with the end id, of as many texts at once as have ``TOGETHER`` bytes; of a long one slice by slice."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        n = len(text)
        if held and size + n > TOGETHER or n > LONG:
            yield from encoded(held, ids)
            held, size = [], 0
        if n <= LONG:
            held.append(text)
            size += n
            continue
        whole = bytearray()
        for part in slices(text):
            whole += next(encoded([part], ids))[:-4]
        yield bytes(whole) + next(encoded([b""], ids))
    yield from encoded(held, ids)


def _windows(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        stream = Stream(sentence_ends(ids), capacity, TaskContext.get().partitionId() << 36)
        try:
            for batch in batches:
                texts = batch.column(1).cast(pa.binary()).fill_null(b"")
                for doc_id, buf in zip(batch.column(0).to_pylist(), ids_of(texts.to_pylist(), ids), strict=True):
                    stream.add(doc_id, buf)
                    if stream.tokens >= RUN:
                        yield stream.windows()
            if stream.tokens:
                yield stream.windows(0)
        finally:
            ids.forget()

    return run


def order_preserving_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises all documents and packs them in their order: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence_id`` is the task's number and, in the lower 36 bits, the window's number in it."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if capacity < 2:
        raise ValueError("a sequence holds two tokens at least")
    prepare(docs.sparkSession)
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _windows(path, capacity), PIECES)


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, padding (none at a power of two) and pieces that begin inside a document."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_if(F.col("start") > 0).alias("cuts"))
    pad = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, 0).otherwise(capacity - F.col("n"))
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"), F.sum("cuts").alias("cuts"))


def op13_order_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every row of ``documents`` in sequences of at most 2048 tokens."""
    return order_preserving_packing(table(spark, sf_dir, "documents"))
