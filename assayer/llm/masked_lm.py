"""Pseudo-likelihood of documents under a masked language model.

A bidirectional window network in numpy predicts every word from the two words on either side of it:
embeddings of hashed words, a hidden layer, and a softmax over the words as leaves of a tree. A word's
probability is the product of the choices on its path, each a softmax over a node's children that depends on
the context. The tree is cut from an order by co-occurrence (words with like neighbours lie side by side)
into children of about equal mass. Below the leaves, words that share one are told apart by their corpus
counts, in a table that grows with the corpus; a document's own occurrences are left out there, so that a
word counts as known only if another document has it. The score of a document is the sum of the logarithms
of these conditional probabilities.

Counts cover all documents, and so does training: every position of every document is a target once, in
one of the rounds. Tasks train on their own documents from a common start, and their parameters are averaged
with weights of how often each was trained; the second round goes on from there with the other half of the
documents. So scores depend a little on how rows lie in partitions. Sums are reduced by chunk and stream
through the reducers.

Bounds: leaves, nodes and parameters have a fixed number; the table of counts has 2^18 to 2^``CELL_BITS``
cells of a byte, by Spark's estimate of the input's size. Beyond that more words share a cell.

Edge cases: a null or empty text has no words and scores 0; texts of any length are read whole, in blocks;
repeated rows are scored each, equal texts alike but for rounding; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._common import Store, in_arrow, packed, partitions, prepare, table, unpacked, word_hashes

#: Leaves: buckets of hashed words, by the leading bits of the hash.
WORD_BITS = 15
WORDS = 1 << WORD_BITS
SIDE = 2
EMBEDDING, HIDDEN = 8, 16
#: Children of a node.
FANOUT = 32
#: Groups of neighbours, on each side, that words are ordered by.
GROUPS = 16
#: Most bits of a word's cell in the table of counts, and bits that deal cells to reducers.
CELL_BITS, _DEAL_BITS = 24, 8
#: What a cell counts as when all its occurrences are left out.
UNSEEN = 0.05
#: Each document is trained on in one of so many rounds.
ROUNDS = 2
BATCH = 4096
#: Positions that are gathered before they are trained on or counted, however many a batch of documents has.
HELD = 1 << 18
RATE = 4.0
#: Rows of a table of parameters that are reduced together, and numbers of chunks that a table may have.
CHUNK, TABLE = 1024, 1 << 20
SUMS = "chunk int, sums binary, weights binary"
RESULT = "doc_id long, n_words long, log_likelihood double, per_word double"

#: A count's byte: itself up to 32, then eight steps to a doubling.
COUNTS = np.concatenate([np.arange(33), 32 * 2 ** (np.arange(1, 224) / 8)])


def coded(counts: np.ndarray) -> np.ndarray:
    """Bytes that stand for counts."""
    return np.minimum(np.searchsorted(COUNTS, counts * (1 - 1e-9)), 255).astype(np.uint8)


def contexts(ids: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The words around each position (or the given ones); ``WORDS`` beyond the ends."""
    padded = np.full(len(ids) + 2 * SIDE, WORDS, np.int32)
    padded[SIDE : SIDE + len(ids)] = ids
    at = np.arange(len(ids)) if at is None else at
    return np.stack([padded[at + k] for k in range(2 * SIDE + 1) if k != SIDE], 1)


def leaves(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)


# -- the tree ---------------------------------------------------------------------------------------


def order_of(neighbours: np.ndarray, weights: np.ndarray, least: float = 1 / 256) -> np.ndarray:
    """Words ordered so that those with like neighbours lie side by side: halves by the main direction, again and again, down
    to a share ``least`` of the mass; then the frequent ones first."""
    n = neighbours.sum(1, keepdims=True)
    share = np.sqrt((neighbours + 4 * neighbours.sum(0) / max(neighbours.sum(), 1)) / (n + 4))
    out, todo = [], [np.arange(len(weights))]
    while todo:
        own = todo.pop()
        w = weights[own]
        if len(own) <= 2 or w.sum() <= least * weights.sum():
            out.append(own[np.argsort(-w, kind="stable")])
            continue
        x = share[own]
        x = x - (x * w[:, None]).sum(0) / w.sum()
        direction = np.linalg.eigh((x * w[:, None]).T @ x)[1][:, -1]
        order = np.argsort(x @ direction, kind="stable")
        at = min(max(int(np.searchsorted(np.cumsum(w[order]), w.sum() / 2)), 1), len(own) - 1)
        todo += [own[order[at:]], own[order[:at]]]
    return np.concatenate(out)


def tree_of(order: np.ndarray, weights: np.ndarray, deepest: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its nodes and children by level, and its depth; and the mass of each node's children.

    A node's words are cut into at most FANOUT runs of about equal mass, none empty (of equal length near the deepest level).
    """
    n = len(order)
    before = np.concatenate([[0.0], np.cumsum(weights[order])])
    nodes, children, depth = np.zeros((deepest, n), np.uint16), np.zeros((deepest, n), np.int8), np.zeros(n, np.int8)
    mass, todo = [], [(0, n, 0)]
    while todo:
        a, b, level = todo.pop()
        k = min(FANOUT, b - a)
        cuts = np.linspace(a, b, k + 1).astype(np.int64)
        if b - a > FANOUT and level < deepest - 5:
            cuts[1:-1] = np.searchsorted(before, before[a] + (before[b] - before[a]) * np.arange(1, k) / k)
            cuts = np.minimum(np.maximum(cuts, a + np.arange(k + 1)), b - np.arange(k, -1, -1))
        own = np.zeros(FANOUT)
        own[:k] = before[cuts[1:]] - before[cuts[:-1]]
        for j, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
            at = order[x:y]
            nodes[level, at], children[level, at], depth[at] = len(mass), j, level + 1
            if y - x > 1:
                todo.append((x, y, level + 1))
        mass.append(own)
    levels = int(depth.max())
    return nodes[:levels].copy(), children[:levels].copy(), depth, np.array(mass)


class Network:
    """Parameters, and what follows from the corpus counts.

    ``e`` embeds words, ``w`` and ``b`` are the hidden layer h; the choice at a node of level k is the softmax of
    (h * s[node]) @ v[k] + a[node]; a node's a and s are its row of ``p``.
    """

    FLAT = ("w", "b", "v")

    def __init__(self, counts: np.ndarray, neighbours: np.ndarray | None = None, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.counts = counts
        smooth = counts + 1.0
        order = np.argsort(-smooth, kind="stable") if neighbours is None else order_of(neighbours, smooth)
        self.nodes, self.children, self.depth, mass = tree_of(order, smooth)
        self.e = (rng.standard_normal((WORDS + 1, EMBEDDING)) * 0.3).astype(np.float32)
        self.w = (rng.standard_normal((2 * SIDE * EMBEDDING, HIDDEN)) * 0.2).astype(np.float32)
        self.b = np.zeros(HIDDEN, np.float32)
        self.v = (rng.standard_normal((len(self.nodes), HIDDEN, FANOUT)) * 0.05).astype(np.float32)
        self.p = np.ones((len(mass), FANOUT + HIDDEN), np.float32)
        self.a[:] = np.log(np.maximum(mass / mass.sum(1, keepdims=True), 1e-13))

    @property
    def a(self) -> np.ndarray:
        return self.p[:, :FANOUT]

    @property
    def s(self) -> np.ndarray:
        return self.p[:, FANOUT:]

    def copy(self) -> Network:
        new = object.__new__(Network)
        new.__dict__ = {k: (v.copy() if k in "ewbvp" else v) for k, v in self.__dict__.items()}
        return new

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.e[context].reshape(len(context), -1)
        h = x @ self.w
        h += self.b
        return x, np.tanh(h, out=h)

    def choice(self, g: np.ndarray, level: int, bias: np.ndarray) -> np.ndarray:
        """Logits of the children; none is so large that its exponential overflows."""
        z = g @ self.v[level]
        z += bias
        return np.minimum(z, np.float32(60), out=z)

    def log_probabilities(self, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log P(word | its context) at each position; over all words, their exponentials sum to 1."""
        h = self.hidden(context)[1]
        depth, found = self.depth[ids], np.zeros(len(ids), np.float32)
        for level in range(len(self.nodes)):
            at = np.flatnonzero(depth > level)
            if not len(at):
                break
            if level:
                q = self.p[self.nodes[level][ids[at]]]
                z = self.choice(h[at] * q[:, FANOUT:], level, q[:, :FANOUT])
            else:
                z = self.choice(h, 0, self.a[0])
            own = z[np.arange(len(at)), self.children[level][ids[at]]]
            found[at] += own - np.log(np.exp(z, out=z).sum(1) + np.float32(1e-30))
        return found

    def train(self, ids: np.ndarray, context: np.ndarray, rate: float, visits: np.ndarray | None = None) -> None:
        """One step of gradient descent on the cross-entropy of every choice on the words' paths."""
        n = len(ids)
        x, h = self.hidden(context)
        depth, dh, mean = self.depth[ids], np.zeros_like(h), np.float32(rate / n)
        for level in range(len(self.nodes)):
            at = np.flatnonzero(depth > level)
            if not len(at):
                break
            node = self.nodes[level][ids[at]]
            if level:
                order = np.argsort(node, kind="stable")
                at, node = at[order], node[order]
            if level:
                own, q = h[at], self.p[node]
                s = q[:, FANOUT:]
                g = own * s
                z = self.choice(g, level, q[:, :FANOUT])
            else:
                g = h
                z = self.choice(g, 0, self.a[0])
            np.exp(z, out=z)
            z *= 1 / (z.sum(1, keepdims=True) + np.float32(1e-30))
            z[np.arange(len(at)), self.children[level][ids[at]]] -= 1
            d = z @ self.v[level].T
            self.v[level] -= mean * (g.T @ z)
            if level:
                dh[at] += d * s
                q[:, :FANOUT] = z
                np.multiply(own, d, out=s)
                cut = np.flatnonzero(np.diff(node.astype(np.int32), prepend=-1))
                often = np.diff(np.append(cut, len(node)))
                # between a sum and a mean over a node's positions, so that rare nodes learn about as fast as frequent ones
                sums, which = np.add.reduceat(q, cut, axis=0), node[cut]
                sums *= np.float32(rate / 16) / np.sqrt(often.astype(np.float32))[:, None]
                self.p[which] -= sums
                if visits is not None:
                    visits[which] += often
            else:
                self.a[0] -= mean * z.sum(0)
                dh += d
                if visits is not None:
                    visits[0] += n
        h *= h
        dh *= 1 - h
        g = (dh @ self.w.T).reshape(-1, EMBEDDING)
        self.w -= mean * (x.T @ dh)
        self.b -= mean * dh.sum(0)
        flat = context.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        cut = np.flatnonzero(np.diff(flat.astype(np.int32), prepend=-1))
        sums = np.add.reduceat(g[order], cut, axis=0)
        sums *= np.float32(rate / 16) / np.sqrt(np.diff(np.append(cut, len(flat))).astype(np.float32))[:, None]
        self.e[flat[cut]] -= sums


# -- counts -----------------------------------------------------------------------------------------


def cell_bits(docs: DataFrame) -> int:
    """Bits of a word's cell: a cell for each 16 bytes of input, 2^18 at least, 2^CELL_BITS at most."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max((size // 16).bit_length(), 18), CELL_BITS)


def _grouped(texts: list[str | None], held: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Hashes of the texts' words, held until there are HELD."""
    size = sum(map(len, held))
    for h in word_hashes(texts, lower=True):
        if len(h):
            held.append(h)
            size += len(h)
        if size >= HELD:
            yield np.concatenate(held)
            held.clear()
            size = 0


def _counts(bits: int):
    """Occurrences of words by cell (chunk: part of the cells; sums: packed), and of leaves with the groups of their neighbours (by chunk of leaves, from TABLE on)."""
    low = np.uint64(bits - _DEAL_BITS)

    def cells(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, n = np.unique(h >> np.uint64(64 - bits), return_counts=True)
        cuts = np.searchsorted(values, np.arange((1 << _DEAL_BITS) + 1, dtype=np.uint64) << low).tolist()
        rows = [(b, packed(values[i:j] - (np.uint64(b) << low), n[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
        yield _sums([r[0] for r in rows], [r[1] for r in rows], [b""] * len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, near = np.zeros(WORDS, np.int64), np.zeros(WORDS * 2 * GROUPS, np.int64)
        held: list[np.ndarray] = []

        def add(h: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal total, near
            ids = leaves(h).astype(np.int64)
            total += np.bincount(ids, minlength=WORDS)
            group = (h >> np.uint64(20)).astype(np.int64) % GROUPS
            near += np.bincount(ids[1:] * 2 * GROUPS + group[:-1], minlength=len(near))
            near += np.bincount(ids[:-1] * 2 * GROUPS + GROUPS + group[1:], minlength=len(near))
            yield from cells(h)

        for b in batches:
            for h in _grouped(b.column(0).to_pylist(), held):
                yield from add(h)
        if held:
            yield from add(np.concatenate(held))
        rows = near.reshape(WORDS, -1)
        for k in range(0, WORDS, CHUNK):
            if total[k : k + CHUNK].any():
                yield _sums([TABLE + k // CHUNK], [rows[k : k + CHUNK].astype(np.float32).tobytes()], [total[k : k + CHUNK].astype(np.float32).tobytes()])

    return run


def _sums(chunks: list[int], sums: list[bytes], weights: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(sums, pa.binary()), pa.array(weights, pa.binary())], names=["chunk", "sums", "weights"])


def _reduce(bits: int | None = None):
    """Rows sorted by chunk: sums of sums and weights; chunks below TABLE, with ``bits``: cells' counts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, None

        def done() -> pa.RecordBatch:
            return _sums([last], *([x.tobytes()] for x in found)) if isinstance(found, list) else _sums([last], [coded(found).tobytes()], [b""])

        for b in batches:
            for chunk, sums, weights in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if chunk != last and found is not None:
                    yield done()
                    found = None
                last = chunk
                if bits is not None and chunk < TABLE:
                    values, n = unpacked(sums.as_buffer())
                    found = np.zeros(1 << (bits - _DEAL_BITS), np.int64) if found is None else found
                    found[values.astype(np.int64)] += n
                else:
                    new = [np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in (sums, weights)]
                    found = new if found is None else [a + x for a, x in zip(found, new, strict=True)]
        if found is not None:
            yield done()

    return run


def _summed(rows: DataFrame, bits: int | None = None) -> DataFrame:
    n = min(partitions(rows.sparkSession), 1 << _DEAL_BITS)
    return in_arrow(rows.repartition(n, "chunk").sortWithinPartitions("chunk"), _reduce(bits), SUMS)


# -- training ---------------------------------------------------------------------------------------


def round_of(text: str) -> int:
    return zlib.crc32(text[:256].encode("utf-8", "replace"), len(text)) % ROUNDS


def _train(start: Network, turn: int):
    """Trains on the documents of a round; gives chunks of weighted parameters and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = start.copy()
        seen, visits = np.zeros(WORDS + 1, np.float32), np.zeros(len(net.p), np.float32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = steps = 0

        def step() -> None:
            nonlocal size, steps, seen
            ids, context = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            for i in range(0, len(ids), BATCH):
                net.train(ids[i : i + BATCH], context[i : i + BATCH], RATE / (1 + turn) / (1 + steps / 400), visits)
                steps += 1
            seen += np.bincount(context.ravel(), minlength=WORDS + 1).astype(np.float32)
            held.clear()
            size = 0

        for b in batches:
            for h in word_hashes([x for x in b.column(0).to_pylist() if x and round_of(x) == turn], lower=True):
                if len(h):
                    ids = leaves(h)
                    held.append((ids, contexts(ids)))
                    size += len(ids)
                if size >= HELD:
                    step()
            if size >= BATCH:
                step()
        if size:
            step()
        if not steps:
            return
        for number, rows, weights in ((0, net.e, seen), (1, net.p, visits)):
            for k in range(0, len(rows), CHUNK):
                n = weights[k : k + CHUNK]
                if n.any():
                    yield _sums([number * TABLE + k // CHUNK], [(rows[k : k + CHUNK] * n[:, None]).tobytes()], [n.tobytes()])
        rest = np.concatenate([getattr(net, k).ravel() for k in Network.FLAT])
        yield _sums([-1], [(rest * np.float32(steps)).tobytes()], [np.full(1, steps, np.float32).tobytes()])

    return run


class Model:
    """A trained network with the table of cells."""

    def __init__(self, net: Network, cells: np.ndarray):
        self.net, self.cells = net, cells
        self.bits = len(cells).bit_length() - 1

    def scores(self, documents: list[np.ndarray]) -> np.ndarray:
        """Of documents (hashes of their words) the sums of log-probabilities."""
        sums = np.zeros(len(documents))
        at = 0
        while at < len(documents):  # short documents go through the network together
            group, size = [at], len(documents[at])
            while group[-1] + 1 < len(documents) and size + len(documents[group[-1] + 1]) <= BATCH:
                group.append(group[-1] + 1)
                size += len(documents[group[-1]])
            own = [documents[i] for i in group]
            which = np.repeat(np.arange(len(group)), list(map(len, own)))
            h = np.concatenate(own)
            p = self.within(h, which)
            if len(group) == 1:
                ids = leaves(h)
                for i in range(0, len(ids), BATCH):
                    k = np.arange(i, min(i + BATCH, len(ids)))
                    first = max(0, i - SIDE)
                    p[k] += self.net.log_probabilities(ids[k], contexts(ids[first : i + BATCH + SIDE], k - first))
            elif size:
                p += self.net.log_probabilities(leaves(h), np.concatenate([contexts(leaves(x)) for x in own]))
            sums[group] = np.bincount(which, p, len(group))
            at = group[-1] + 1
        return sums

    def within(self, h: np.ndarray, document: np.ndarray) -> np.ndarray:
        """log P(word | its leaf) from the counts of all other documents."""
        cell = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        _, at, often = np.unique(document << self.bits | cell, return_inverse=True, return_counts=True)
        own = often[at]
        each = 1 << (self.bits - WORD_BITS)
        count = np.maximum(COUNTS[self.cells[cell]] - own, 0)
        rest = np.maximum(self.net.counts[cell >> (self.bits - WORD_BITS)] - own, count)
        return np.log((count + UNSEEN) / (rest + UNSEEN * each))


def fit(docs: DataFrame) -> Model:
    """Counts and trains on all documents."""
    spark = docs.sparkSession
    prepare(spark)
    store = Store(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    bits = cell_bits(texts)
    found = store.keep(_summed(in_arrow(texts, _counts(bits), SUMS), bits))
    counts, neighbours, cells = np.zeros(WORDS), np.zeros((WORDS, 2 * GROUPS)), np.zeros(1 << bits, np.uint8)
    part = len(cells) >> _DEAL_BITS
    for chunk, sums, weights in found.toLocalIterator():  # a row for each chunk of cells and of leaves
        if chunk < TABLE:
            cells[chunk * part : (chunk + 1) * part] = np.frombuffer(sums, np.uint8)
        else:
            k = (chunk - TABLE) * CHUNK
            neighbours[k : k + CHUNK], counts[k : k + CHUNK] = np.frombuffer(sums).reshape(CHUNK, -1), np.frombuffer(weights)
    store.drop(found)
    net = Network(counts, neighbours)
    for turn in range(ROUNDS):
        for chunk, own, weights in _summed(in_arrow(texts, _train(net, turn), SUMS)).collect():  # a row for each chunk
            s, n = np.frombuffer(own), np.frombuffer(weights)
            if chunk < 0:
                at = 0
                for k in Network.FLAT:
                    x = getattr(net, k)
                    x[...] = (s[at : at + x.size] / n[0]).reshape(x.shape)
                    at += x.size
                continue
            k = chunk % TABLE * CHUNK
            good = np.flatnonzero(n > 0)
            mean = s.reshape(len(n), -1)[good] / n[good, None]
            if chunk < TABLE:
                net.e[k + good] = mean
            else:
                net.p[k + good] = mean
    return Model(net, cells)


def _score(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = word_hashes(b.column(1).to_pylist(), lower=True)
            sums, n = model.value.scores(h), np.array([len(x) for x in h], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sums), pa.array(sums / np.maximum(n, 1))], names=["doc_id", "n_words", "log_likelihood", "per_word"])

    return run


def pseudo_likelihood(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, log_likelihood, per_word. Without a model, one is fitted on ``docs``."""
    prepare(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _score(own), RESULT)


def op2_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every row of ``documents`` under a model of all of them."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
