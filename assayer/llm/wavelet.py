"""Ranked lexical search: dual-sorted wavelet trees, one for each shard of documents.

A shard concatenates the postings of all its terms, each list by falling impact, and keeps their document numbers in a
wavelet matrix (a bit vector a level, stable). A list is a range of it; a node of the tree is a range of document numbers, and
the part of a list that falls into the node is a range again, still by falling impact, so its first entry bounds what the
term can add to any document below. A query's search opens the nodes of the highest sum of such bounds first and goes down to
single documents, whose sum is their score; what cannot reach the k-th best any more is dropped. The result is exact.
All queries of a group advance together, so that a step is a few array operations on many nodes.

``build`` indexes every row: one pass counts documents and terms, a second writes the shards. ``search`` takes queries in
blocks of checked size; a task goes through its shards, whose k best so far bound the next ones, and returns k rows a
query, of which the best k are kept (a window with a limit, so that each task sends k at most).

Bounds: a shard is closed at ``SHARD_PAIRS`` pairs of term and document (one document more at most), an index row takes
about six bytes a pair; a search holds an entry for each posting of its queries' terms at most, for which queries
are grouped by ``GROUP_PAIRS``; a long text is counted in slices of ``SLICE`` bytes.

Edge cases: a text that is null or has no term is no document of the counts, and is never found; a query without terms has no
row; each row of the queries is a query of its own, also if its id is repeated or null, and each row of the documents a
document of its own; equal scores go by ascending doc_id, null last; fewer than k documents of a score above 0 give
fewer rows; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm._common import Store, in_arrow, prepare, table, utf8

K = 10
#: Terms are the longest runs of other characters; A-Z count as a-z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Weight of a document's length, in hundredths, and the factor of saturation, in thousandths of a term's count.
LENGTH, SATURATION = 75, 8

SHARD_PAIRS, GROUP_PAIRS, SLICE = 1 << 21, 1 << 18, 1 << 20
#: Nodes that a query opens at a time until it has k results; then all that can still hold one of the best.
WIDTH = 128
#: Queries of a block, and their bytes; a block is sent to all executors.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20

_TO = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_INDEX = pa.schema([("ids", pa.binary()), ("no_id", pa.binary()), ("terms", pa.binary()), ("starts", pa.binary()), ("words", pa.binary()), ("zeros", pa.binary()), ("impacts", pa.binary())])
INDEX = ", ".join(f"{n} binary" for n in _INDEX.names)
_FOUND = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms(data: bytes) -> list[bytes]:
    return data.translate(_TO).split()


def counted(data: bytes) -> Counter:
    """Terms of a text with their counts; a long text slice by slice."""
    if len(data) <= SLICE:
        return Counter(terms(data))
    out: Counter = Counter()
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and _TO[data[end]] != 32:
            end += 1
        out.update(terms(data[at:end]))
        at = end
    return out


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + SATURATION * m)


class _Codes(dict):
    """Numbers terms in the order in which they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Builder:
    """Collects documents and makes a shard of them; ``n`` documents with ``total`` terms are in all shards together."""

    def __init__(self, n: int, total: int):
        self.n, self.total = n, max(total, 1)
        self.clear()

    def clear(self) -> None:
        self.codes, self.ids, self.m = _Codes(), [], []
        self.term, self.tf, self.pairs = [], [], 0

    def add(self, doc_id: int | None, counts: Counter) -> None:
        if not counts:
            return
        self.ids.append(doc_id)
        self.m.append(100 - LENGTH + (LENGTH * sum(counts.values()) * self.n) // self.total)
        self.term.append(np.fromiter(map(self.codes.__getitem__, counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.pairs += len(counts)

    def shard(self) -> pa.RecordBatch:
        """The index row of what has been added, which is then forgotten."""
        none = np.array([i is None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        by_id = np.lexsort((ids, none))
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        sizes = [len(x) for x in self.term]
        names = sorted(self.codes)
        rank = np.empty(len(names), np.int32)
        rank[np.fromiter(map(self.codes.__getitem__, names), np.int32, len(names))] = np.arange(len(names))
        term = rank[np.concatenate(self.term)]
        doc = np.repeat(place, sizes).astype(np.int32)
        value = impact(np.concatenate(self.tf), np.repeat(np.array(self.m, np.int64), sizes)).astype(np.int32)
        self.clear()
        order = np.lexsort((doc, -value, term))
        doc, value = doc[order], value[order]
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))]).astype(np.int64)
        words, zeros = matrix(doc, levels(len(ids)))
        blobs = (ids[by_id], none[by_id], b" ".join(names), starts, words, zeros, value)
        return pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in blobs], schema=_INDEX)


def levels(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def matrix(doc: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each level, from the highest on, in words of 64, and the number of zeros of each level."""
    size = -(-len(doc) // 64) + 1
    words, zeros = np.zeros((height, size), np.uint64), np.zeros(height, np.int64)
    for level in range(height):
        bit = (doc >> (height - 1 - level)) & 1 == 1
        packed = np.packbits(bit, bitorder="little")
        words[level].view(np.uint8)[: len(packed)] = packed
        zeros[level] = len(doc) - np.count_nonzero(bit)
        doc = np.concatenate([doc[~bit], doc[bit]])
    return words, zeros


def _build(n: int, total: int, shard_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Builder(n, total)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own.add(doc_id, counted(utf8(text.as_py())))
                if own.pairs >= shard_pairs:
                    yield own.shard()
        if own.pairs:
            yield own.shard()

    return run


class Shard:
    """An index row, ready for search: the bits with running counts, and the impacts in the order of each level."""

    def __init__(self, row: dict[str, bytes]):
        self.ids, self.no_id = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["no_id"], bool)
        self.starts, self.zeros = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["zeros"], np.int64)
        self.height = len(self.zeros)
        words = np.frombuffer(row["words"], np.uint64).reshape(self.height, -1)
        self.width = words.shape[1]
        self.words = words.ravel()
        ones = np.bitwise_count(words)
        self.ranks = (np.cumsum(ones, axis=1, dtype=np.int32) - ones).ravel()
        value = np.frombuffer(row["impacts"], np.int32)
        self.size = len(value)
        # below the last level an upper bound of 16 bits does: sixteenths, rounded up
        self.bounds = np.empty((self.height - 1, self.size), np.uint16)
        for level in range(self.height):
            bit = np.unpackbits(words[level].view(np.uint8), count=self.size, bitorder="little").view(bool)
            value = np.concatenate([value[~bit], value[bit]])
            if level + 1 < self.height:
                self.bounds[level] = (value + 15) >> 4
        self.exact = value
        self.bounds = self.bounds.ravel()

    def rank(self, level: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Ones before place p of a level."""
        at = level * self.width + (p >> 6)
        return self.ranks[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def first(self, level: np.ndarray, s: np.ndarray) -> np.ndarray:
        """A bound of the highest impact of a range that begins at place s below ``level`` levels; exact at the last one."""
        out = np.empty(len(s), np.int64)
        last = level == self.height
        out[last] = self.exact[s[last]]
        out[~last] = self.bounds[(level[~last] - 1) * self.size + s[~last]].astype(np.int64) << 4
        return out


class Best:
    """The k best documents of each query so far: score, whether without id, id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.q, self.score, self.none, self.id = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        self.least, self.full = np.zeros(n, np.int64), np.zeros(n, bool)
        self.last_none, self.last_id = np.ones(n, bool), np.full(n, np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, score: np.ndarray, none: np.ndarray, doc_id: np.ndarray) -> None:
        q, score, none, doc_id = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.none, none), (self.id, doc_id)))
        order = np.lexsort((doc_id, none, -score, q))
        q = q[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[nth < self.k]
        self.q, self.score, self.none, self.id = q[nth < self.k], score[keep], none[keep], doc_id[keep]
        full = np.flatnonzero(nth[nth < self.k] == self.k - 1)
        at = self.q[full]
        self.full[at] = True
        self.least[at], self.last_none[at], self.last_id[at] = self.score[full], self.none[full], self.id[full]

    def may_hold(self, q: np.ndarray, bound: np.ndarray, none: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        """Whether documents of at most such a score, from this id on, can be among the k best; scores of 0 never are."""
        later = (none & ~self.last_none[q]) | ((none == self.last_none[q]) & (doc_id >= self.last_id[q]))
        return (bound > self.least[q]) | ((bound == self.least[q]) & (bound > 0) & ~later)


def look_up(shard_terms: list[bytes], term: bytes) -> int:
    """The number of a term in a shard's sorted terms, or -1."""
    i = bisect_left(shard_terms, term)
    return i if i < len(shard_terms) and shard_terms[i] == term else -1


def explore(shard: Shard, q: np.ndarray, weight: np.ndarray, term: np.ndarray, best: Best, width: int = WIDTH) -> None:
    """Adds a shard's best documents for lists (query, weight, term of the shard): the open nodes of all queries are
    kept together with the ranges of their lists, and each step opens the most promising ones of each query."""
    queries, owner = np.unique(q, return_inverse=True)
    start, end = shard.starts[term], shard.starts[term + 1]
    # open nodes, and their ranges: of node ``owner``, from ``start`` to ``end`` in the order of the node's level
    node_q, level, prefix = queries, np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    bound = np.bincount(owner, weight * 1_000_000, len(queries)).astype(np.int64)
    while len(node_q):
        order = np.lexsort((-bound, node_q))
        sorted_q = node_q[order]
        chosen = np.zeros(len(node_q), bool)
        nth = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
        chosen[order[(nth < width) | best.full[sorted_q]]] = True
        number = np.cumsum(chosen) - 1
        own = chosen[owner]
        at, lv, w = owner[own], level[owner[own]], weight[own]
        s1, e1 = shard.rank(lv, start[own]), shard.rank(lv, end[own])
        child = np.concatenate([2 * number[at], 2 * number[at] + 1])
        s = np.concatenate([start[own] - s1, shard.zeros[lv] + s1])
        e = np.concatenate([end[own] - e1, shard.zeros[lv] + e1])
        w, lv = np.concatenate([w, w]), np.concatenate([lv, lv]) + 1
        some = s < e
        child, s, e, w, lv = child[some], s[some], e[some], w[some], lv[some]
        n_new = 2 * int(chosen.sum())
        new_bound = np.bincount(child, (w * shard.first(lv, s)).astype(np.float64), n_new).astype(np.int64)
        new_q, new_level = np.repeat(node_q[chosen], 2), np.repeat(level[chosen], 2) + 1
        new_prefix = 2 * np.repeat(prefix[chosen], 2) + np.tile([0, 1], n_new // 2)
        leaf = (new_level == shard.height) & (new_bound > 0)
        if leaf.any():
            doc = new_prefix[leaf]
            best.add(new_q[leaf], new_bound[leaf], shard.no_id[doc], shard.ids[doc])
        # what stays open: nodes that were not chosen, and inner children
        node_q, level, prefix, bound = (np.concatenate(x) for x in ((node_q[~chosen], new_q), (level[~chosen], new_level), (prefix[~chosen], new_prefix), (bound[~chosen], new_bound)))
        rest = np.cumsum(~chosen) - 1
        owner = np.concatenate([rest[owner[~own]], child + int((~chosen).sum())])
        start, end, weight = np.concatenate([start[~own], s]), np.concatenate([end[~own], e]), np.concatenate([weight[~own], w])
        low = np.minimum(prefix << (shard.height - level), len(shard.ids) - 1)
        keep = (level < shard.height) & (bound > 0) & best.may_hold(node_q, bound, shard.no_id[low], shard.ids[low])
        number = np.cumsum(keep) - 1
        mine = keep[owner]
        owner, start, end, weight = number[owner[mine]], start[mine], end[mine], weight[mine]
        node_q, level, prefix, bound = node_q[keep], level[keep], prefix[keep], bound[keep]


def _frequencies(block):
    """Of each term of the queries, the documents of each shard that hold it."""
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = block.value[0]
        for batch in batches:
            for held, starts in zip(batch.column(0), batch.column(1), strict=True):
                own, at = held.as_py().split(b" "), np.frombuffer(starts.as_py(), np.int64)
                found = [(i, int(at[j + 1] - at[j])) for i, name in enumerate(names) if (j := look_up(own, name)) >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], schema=schema)

    return run


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists, weights = block.value
        best = Best(len(lists), k)
        for batch in batches:
            for row in range(batch.num_rows):
                blobs = batch.slice(row, 1).to_pylist()[0]
                own = blobs["terms"].split(b" ")
                numbers = np.array([look_up(own, name) for name in names], np.int64)
                del own
                shard = Shard(blobs)
                sizes = np.where(numbers >= 0, shard.starts[numbers + 1] - shard.starts[numbers], 0)
                group: list[np.ndarray] = []
                held = 0
                for i, (term, times) in enumerate(lists):
                    some = (numbers[term] >= 0) & (weights[term] > 0)
                    group.append(np.stack([np.full(int(some.sum()), i), (weights[term] * times)[some], numbers[term][some]]))
                    held += int(sizes[term][some].sum())
                    if held >= GROUP_PAIRS or i + 1 == len(lists):
                        explore(shard, *np.concatenate(group, axis=1), best)
                        group, held = [], 0
        doc = [None if none else i for none, i in zip(best.none.tolist(), best.id.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(best.q), pa.array(doc, pa.int64()), pa.array(best.score)], schema=_FOUND)

    return run


class Index:
    """Written shards of all documents, with the number of documents that have terms."""

    def __init__(self, shards: DataFrame, n: int):
        self.shards, self.n = shards, n

    def weights(self, names: list[bytes], block) -> np.ndarray:
        """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term; df counts over all shards, a row a term and task."""
        found = in_arrow(self.shards.select("terms", "starts"), _frequencies(block), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = {r["term"]: r["df"] for r in found.collect()}  # at most a block's terms
        return np.array([math.floor(1000 * math.log((2 * self.n + 2) / (2 * df[i] + 1))) if i in df else 0 for i in range(len(names))], np.int64)

    def search(self, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """item_id, rank, doc_id, score of the k best documents of each row of ``queries`` (item_id, text)."""
        spark = self.shards.sparkSession
        queries = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        total = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        store = Store(spark)
        blocks = max(1, -(-2 * total[0] // block_rows), -(-2 * total[1] // block_bytes))  # dealt out evenly, with room for chance
        numbered = store.keep(queries.withColumn("query", F.monotonically_increasing_id())) if blocks > 1 else queries.withColumn("query", F.monotonically_increasing_id())
        parts = []
        for b in range(blocks):
            rows = (numbered.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b) if blocks > 1 else numbered).select("item_id", "text").collect()
            parts.append(store.keep(self._block(rows, k)) if blocks > 1 else self._block(rows, k))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _block(self, rows: list, k: int) -> DataFrame:
        spark = self.shards.sparkSession
        counts = [Counter(terms(utf8(r["text"]))) for r in rows]
        names = sorted(set().union(*counts))
        code = {t: i for i, t in enumerate(names)}
        lists = [(np.fromiter(map(code.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))) for c in counts]
        weights = self.weights(names, spark.sparkContext.broadcast((names,))) if names else np.zeros(0, np.int64)
        found = in_arrow(self.shards, _search(spark.sparkContext.broadcast((names, lists, weights)), k), "query long, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k)
        items = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "query long, item_id long")
        return best.join(F.broadcast(items), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def build(docs: DataFrame, shard_pairs: int = SHARD_PAIRS) -> Index:
    """Indexes every row of ``docs`` (doc_id, text): counts first, then the shards, which are written."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = F.regexp_count("text", F.lit(TERM)).cast("long")
    total = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(Store(spark).keep(in_arrow(docs, _build(int(total[0]), int(total[1]), shard_pairs), INDEX)), int(total[0]))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return build(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"))
