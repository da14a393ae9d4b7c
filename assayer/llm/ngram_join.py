"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of hashed word n-grams. Tokens are ordered globally: those in at most ``LIGHT``
documents first, then by the logarithm of their document frequency, then by hash. Two documents of
Jaccard t or more share at least l tokens among their first ``size - ceil(t size) + l`` tokens, so each
document may choose its own l: it takes the one of least estimated cost (lengths of the lists that its
prefix reads, plus candidates expected to share l tokens times the size of a verification), and a pair
needs min(l, l') shared prefix tokens before it is verified. Once the pair's sizes are known, only tokens
within the shorter prefixes that its own overlap asks for count.

Groups of copies never expand into rows of pairs. Exact copies are one vertex. Then each document is
compared with the most typical document of its lists. Many documents around one of these are a cluster:
its members in different components are compared in blocks, by products of token matrices, which give no
more rows than they have members. Every other pair that shares enough prefix tokens across two components
is verified, so no link between different components is lost, and links inside one can't change it.

Edge cases: texts that are null or have no word have no tokens and link with nothing; a text of fewer
words than n is one token; texts of any length are read whole, in blocks of words; repeated rows are copies; rows that repeat a doc_id with other texts are
versions of one document; a null doc_id links with nothing and has no component; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._common import Store, in_arrow, mix, packed, partitions, prepare, table, unpacked, windows, word_hashes
from assayer.llm.components import components

#: Tokens in at most so many documents are ordered by hash alone.
LIGHT = 48
#: Most frequent tokens that are broadcast; beyond it the least frequent of them count as light.
HEAVY_TOKENS = 2_000_000
#: Documents that gather around one typical document before they are compared in blocks, and a block's size.
CLUSTER = 48
BLOCK = 384
#: Largest number of shared prefix tokens that is asked for.
MOST_SHARED = 6
#: Bits of a token that count its documents. Any order of tokens is right; collisions only cost time.
_BITS = 48
#: A bucket of tokens is counted at once: leading bits so that it has about _BUCKET_TOKENS tokens, by Spark's estimate of the input's size.
_BUCKET_BITS, _MOST_BUCKET_BITS, _BUCKET_TOKENS = 10, 20, 1 << 22
#: Tokens that a task counts together before they are dealt to buckets.
_CHUNK = 1 << 20
_FILTER_BITS = 22
#: Most ids of documents to drop that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Leading bits of a token that index a bitmap of tokens in two documents or more. Its size is fixed; the fuller it is, the fewer prefix tokens it spares.
_SEEN_BITS = 27
SHORT = np.uint64(0x5851F42D4C957F2D)


def tokens(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its lower-cased (A-Z) word n-grams; a shorter text is one token."""
    return [_grams(h, n) for h in word_hashes(texts, lower=True)]


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) >= n:
        g = windows(h, n)
        g.sort()
        new = np.ones(len(g), bool)
        np.not_equal(g[1:], g[:-1], out=new[1:])
        return g[new]
    if not len(h):
        return h
    out = np.full(1, SHORT ^ np.uint64(len(h)), np.uint64)
    for x in h:
        out = mix(out, np.full(1, x, np.uint64))
    return out


# -- document frequencies ---------------------------------------------------------------------------


def bucket_bits(docs: DataFrame) -> int:
    """Any number gives the same counts."""
    tokens = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // 4
    return min(max(_BUCKET_BITS, (tokens // _BUCKET_TOKENS).bit_length()), _MOST_BUCKET_BITS)


def _fingerprints(n: int, bits: int):
    def flush(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate(sets)
        sets.clear()
        values >>= np.uint64(64 - _BITS)
        values.sort()
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        counts = np.diff(first, append=len(values))
        values = values[first]
        low = np.uint64(_BITS - bits)
        own, at = np.unique(values >> low, return_index=True)
        cuts = [*at.tolist(), len(values)]
        for i in range(0, len(own), 256):
            part = own[i : i + 256]
            blobs = [packed(values[cuts[k] : cuts[k + 1]] - (own[k] << low), counts[cuts[k] : cuts[k + 1]]) for k in range(i, i + len(part))]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0
        for b in batches:
            for h in tokens(b.column(0).to_pylist(), n):
                sets.append(h)
                size += len(h)
                if size >= _CHUNK:
                    yield from flush(sets)
                    sets, size = [], 0
        if size:
            yield from flush(sets)

    return run


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _frequent(bits: int):
    """Rows sorted by bucket. Tokens in more than LIGHT documents, at -1 and -2 sums over the others, and at -3 - k the k-th part of the bitmap."""
    seen_bits = max(_SEEN_BITS - bits, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0, 0]

        def flush(bucket: int, parts: list) -> pa.RecordBatch:
            values, df = _summed(parts)
            light = df <= LIGHT
            sums[0] += int(df[light].sum())
            sums[1] += int((df[light] ** 2).sum())
            full = (values[~light] + (np.uint64(bucket) << np.uint64(_BITS - bits))).astype(np.int64)
            seen = np.zeros(1 << seen_bits, bool)
            seen[values[df > 1] >> np.uint64(_BITS - bits - seen_bits)] = True
            return pa.RecordBatch.from_arrays([pa.array([*full.tolist(), -3 - bucket], pa.int64()), pa.array([*df[~light].tolist(), 0], pa.int64()), pa.array([None] * len(full) + [np.packbits(seen).tobytes()], pa.binary())], names=["token", "df", "bits"])

        last, parts, size, distinct = -1, [], 0, 0
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if bucket != last and parts:
                    yield flush(last, parts)
                    parts, size, distinct = [], 0, 0
                last = bucket
                parts.append(unpacked(blob.as_buffer()))
                size += len(parts[-1][0])
                if size > 2 * distinct + _CHUNK:  # blobs of a bucket are summed as they come
                    parts = [_summed(parts)]
                    size = distinct = len(parts[0][0])
        if parts:
            yield flush(last, parts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int64()), pa.array(sums, pa.int64()), pa.array([None, None], pa.binary())], names=["token", "df", "bits"])

    return run


class Frequencies:
    """Of frequent tokens, sorted by token; ``light``: how many other documents hold a light token, on average over its places."""

    def __init__(self, found: np.ndarray, df: np.ndarray, light: float, docs: int, seen: np.ndarray):
        order = np.argsort(found)
        self.seen = seen
        self.tokens, self.df, self.light, self.docs = found[order].astype(np.uint64), df[order].astype(np.float32), light, max(docs, 1)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Document frequencies of tokens; 0 for light ones."""
        if not len(self.tokens):
            return np.zeros(len(h), np.float32)
        at = np.searchsorted(self.tokens, h >> np.uint64(64 - _BITS))
        at[at == len(self.tokens)] = 0
        return np.where(self.tokens[at] == h >> np.uint64(64 - _BITS), self.df[at], np.float32(0))


    def again(self, h: np.ndarray) -> np.ndarray:
        """Which tokens may be in another document too."""
        at = h >> np.uint64(64 - _SEEN_BITS)
        return self.seen[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def frequencies(docs: DataFrame, n: int, store: Store) -> Frequencies:
    spark = docs.sparkSession
    bits = bucket_bits(docs)
    blobs = in_arrow(docs.select("text"), _fingerprints(n, bits), "bucket int, blob binary").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    found = store.keep(in_arrow(blobs, _frequent(bits), "token long, df long, bits binary"))
    sums = {r[0]: r[1] for r in found.where("token IN (-1, -2)").groupBy("token").agg(F.sum("df")).collect()}
    heavy = found.where("token >= 0")
    total, cut = 0, LIGHT
    for r in heavy.groupBy(F.floor(F.log2("df")).alias("k")).count().orderBy(F.desc("k")).collect():  # a row for each power of two
        total += r["count"]
        if total > HEAVY_TOKENS:
            cut = 2 ** (r["k"] + 1) - 1
            break
    got = heavy.where(F.col("df") > cut).select("token", "df").toArrow()
    seen = np.zeros(1 << (_SEEN_BITS - 3), np.uint8)
    part = max(len(seen) >> bits, 1)
    for r in found.where("token < -2").select("token", "bits").toLocalIterator():  # one row a bucket
        k = -3 - r["token"]
        seen[k * part : (k + 1) * part] = np.frombuffer(r["bits"], np.uint8)
    return Frequencies(got["token"].to_numpy(), got["df"].to_numpy(), sums.get(-2, 0) / max(sums.get(-1, 0), 1) - 1, docs.count(), seen)


# -- prefixes ---------------------------------------------------------------------------------------


def linkable(size: int, percent: int) -> bool:
    """Whether a set of this size can link with another set than itself."""
    return 100 * size >= percent * (size + 1)


def prefix(h: np.ndarray, percent: int, freq: Frequencies) -> tuple[int, int, np.ndarray, np.ndarray]:
    """How many tokens are known to be this document's alone, the number of shared tokens that it asks for, its prefix without lone tokens, and their places in the global order."""
    size = len(h)
    alone = size - int(np.count_nonzero(freq.again(h)))
    if 100 * (size - alone) < percent * size or not linkable(size, percent):  # it can link with no other set
        return alone, 1, h[:0], np.zeros(0, np.int32)
    need = -(-percent * size // 100)
    df = freq.of(h)
    rank = np.where(df > 0, 1 + np.floor(2 * np.log2(np.maximum(df, 1))), 0)
    most = min(MOST_SHARED, need)
    k = min(size, size - need + most)
    order = np.lexsort((h, rank))[:k]
    others = np.where(df[order] > 0, df[order] - 1, freq.light)
    read = np.cumsum(others)
    best, least = 1, np.inf
    term = 1.0
    for shared in range(1, most + 1):
        lists = float(read[min(size, size - need + shared) - 1])
        term = (lists / freq.docs) ** shared / float(np.prod(np.arange(1.0, shared + 1)))
        cost = lists + size * min(lists / shared, freq.docs * min(term, 1.0))
        if cost < least:
            best, least = shared, cost
    own = h[order[: min(size, size - need + best)]]
    at = np.flatnonzero(freq.again(own))
    return alone, best, own[at], at.astype(np.int32)


def _prefixes(n: int, percent: int, freq: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, key, lone, asked, own, places = [], [], [], [], [], []
            for h in tokens(b.column(1).to_pylist(), n):
                alone, shared, p, at = prefix(h, percent, freq.value)
                lone.append(alone)
                size.append(len(h))
                key.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                asked.append(shared)
                own.append(p.view(np.int64))
                places.append(at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(lone, pa.int64()), pa.array(asked, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "size", "key", "alone", "asked", "prefix", "places"])

    return run


# -- verification -----------------------------------------------------------------------------------


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id, of fixed size: it spares most other texts; a wrong hit costs time only."""
    got = ids.select(F.pmod(F.xxhash64("v"), F.lit(1 << _FILTER_BITS)).cast("int").alias("b")).distinct().toArrow()["b"].to_numpy()
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[got] = True
    return np.packbits(bits)


def _sets(n: int, bits: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bits.value).astype(bool)
        for b in batches:
            b = b.filter(pa.array(wanted[b.column(1).to_numpy(zero_copy_only=False)]))
            h = tokens(b.column(2).to_pylist(), n)
            if len(h):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in h], pa.binary()), pa.array([x.tobytes() for x in h], pa.binary())], names=["v", "key", "tokens"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for s, t in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            b = b.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"])

    return run


def sets_of(ids: DataFrame, docs: DataFrame, reps: DataFrame, n: int, store: Store) -> DataFrame:
    """(v, tokens) of the vertices ``ids`` (v), a written table. Only their texts become sets."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))
    texts = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << _FILTER_BITS)).cast("int").alias("b"), "text").where("doc_id IS NOT NULL")
    wanted = store.keep(reps.select("v", "key").join(ids, "v", "left_semi"))
    sets = store.keep(in_arrow(texts, _sets(n, bits), "v long, key binary, tokens binary").join(wanted, ["v", "key"], "left_semi").dropDuplicates(["v", "key"]).select("v", "tokens"))
    store.drop(wanted)
    return sets


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (x, y) those whose sets reach the threshold."""
    one = sets.select(F.col("v").alias("x"), F.col("tokens").alias("s"))
    two = sets.select(F.col("v").alias("y"), F.col("tokens").alias("t"))
    return in_arrow(pairs.select("x", "y").join(one, "x").join(two, "y").select("x", "y", "s", "t"), _verified(percent), "x long, y long")


def _block_links(percent: int):
    """Rows sorted by (g, i, j): g, i, j, side, v, c, tokens. For each block pair, components (x, y) that its links join, in linear number."""

    def linked(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        side, c = t["side"].to_numpy(), t["c"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["tokens"]]
        sizes = np.array([len(x) for x in sets])
        _, col, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        row, col = row[often[col] > 1], col[often[col] > 1]
        order = np.argsort(col, kind="stable")
        row, col = row[order], np.cumsum(np.diff(col[order], prepend=-1) > 0) - 1
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        both = np.zeros((len(a), len(b)), np.float32)
        for start in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            s, e = np.searchsorted(col, (start, start + 4096))
            part = np.zeros((len(sets), 4096), np.float32)
            part[row[s:e], col[s:e] - start] = 1
            both += part[a] @ part[b].T
        link = 100 * both >= percent * (sizes[a][:, None] + sizes[b][None] - both)
        names, at = np.unique(c, return_inverse=True)
        best = np.arange(len(names))
        while True:  # the smallest component that each reaches
            new = best.copy()
            np.minimum.at(new, at[a], np.where(link, best[at[b]][None], len(names)).min(1, initial=len(names)))
            np.minimum.at(new, at[b], np.where(link, best[at[a]][:, None], len(names)).min(0, initial=len(names)))
            new = new[new]
            if (new == best).all():
                break
            best = new
        moved = np.flatnonzero(best != np.arange(len(names)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[best[moved]])], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[s].tolist())
                if last is not None and key != last:
                    yield from linked(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = key
        if held:
            yield from linked(held)

    return run


def within_clusters(members: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between components (c) of documents (v) of a cluster (g), block by block. ``sizes``: a written table (g, m)."""
    spark = members.sparkSession
    rows = members.join(sizes, "g").withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("side", F.pmod(F.xxhash64("v"), F.col("blocks")))
    rows = rows.select("g", "v", "c", "side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    rows = rows.select("g", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "v", "c").join(sets, "v").select("g", "i", "j", "side", "v", "c", "tokens")
    return in_arrow(rows.repartition(partitions(spark), "g", "i", "j").sortWithinPartitions("g", "i", "j"), _block_links(percent), "x long, y long")


# -- the join ---------------------------------------------------------------------------------------


def _met(a: str, b: str, percent: int) -> F.Column:
    """Whether two documents' sizes and lone tokens allow a link, and a shared token may be one of the first that they share, given the overlap that a pair of their sizes needs."""
    x, y, both = F.col(f"{a}.size"), F.col(f"{b}.size"), F.least(f"{a}.asked", f"{b}.asked")
    u, v = F.col(f"{a}.alone"), F.col(f"{b}.alone")
    need = F.ceil(percent * (x + y) / (100 + percent))
    return (100 * F.least(x - u, y - v) >= percent * F.greatest(x + v, y + u)) & (F.col(f"{a}.place") < x - need + both) & (F.col(f"{b}.place") < y - need + both)


def _star(posts: DataFrame, percent: int) -> DataFrame:
    """(x, y) for each vertex x that shares two tokens or more with the most typical vertex of their lists: y is the one with which it shares most."""
    tip = posts.groupBy("token").agg(F.max(F.struct("typical", "v", "size", "alone", "asked", "place")).alias("t"))
    met = posts.alias("o").join(tip, "token").where((F.col("o.v") != F.col("t.v")) & _met("o", "t", percent))
    return met.groupBy(F.col("o.v").alias("x"), F.col("t.v").alias("y")).agg(F.count("*").alias("k")).where("k > 1").groupBy("x").agg(F.max(F.struct("k", "y")).alias("b")).select("x", "b.y")


def _across(posts: DataFrame, percent: int) -> DataFrame:
    """Every pair of vertices of two components with enough shared prefix tokens, but for those of one cluster (g). In a list, the largest component's members meet only the others."""
    parts = posts.groupBy("token", "c").agg(F.count("*").alias("k"))
    lists = parts.groupBy("token").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("token", F.col("m.c").alias("main"))
    own = posts.join(lists, "token").select("token", "v", "size", "alone", "asked", "place", "c", "g", (F.col("c") != F.col("main")).alias("rest"))
    a, b = own.where("rest").alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.c") != F.col("b.c")) & F.coalesce(F.col("a.g") != F.col("b.g"), F.lit(True)) & (~F.col("b.rest") | (F.col("a.v") < F.col("b.v"))) & _met("a", "b", percent))
    return (
        pairs.groupBy(F.least("a.v", "b.v").alias("x"), F.greatest("a.v", "b.v").alias("y"))
        .agg(F.count("*").alias("k"), F.min(F.least("a.asked", "b.asked")).alias("asked"))
        .where("k >= asked")
        .select("x", "y")
    )


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Two documents link when 100 * shared n-grams >= percent * all n-grams of both.
    """
    spark = docs.sparkSession
    prepare(spark)
    store = Store(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    freq = spark.sparkContext.broadcast(frequencies(docs, n, store))
    rows = store.keep(in_arrow(docs, _prefixes(n, percent, freq), "doc_id long, size long, key binary, alone long, asked int, prefix array<long>, places array<int>"))
    known = rows.where("doc_id IS NOT NULL AND key IS NOT NULL")
    reps = store.keep(known.groupBy("key").agg(F.min("doc_id").alias("v"), F.first("size").alias("size"), F.first("alone").alias("alone"), F.first("asked").alias("asked"), F.first("prefix").alias("prefix"), F.first("places").alias("places")))

    posts = reps.select("v", "size", "alone", "asked", F.explode(F.arrays_zip("prefix", "places")).alias("p")).select("v", "size", "alone", "asked", F.col("p.prefix").alias("token"), F.col("p.places").alias("place"))
    lists = posts.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = store.keep(posts.join(lists, "token"))
    posts = store.keep(shared.join(shared.groupBy("v").agg(F.sum("n").alias("typical")), "v").select("token", "v", "size", "alone", "asked", "place", "typical"))
    store.drop(shared)

    repeated = known.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("doc_id")
    classes = known.join(repeated, "doc_id", "left_semi").select("doc_id", "key").distinct().join(reps.select("key", "v"), "key")
    links = store.keep(classes.select(F.col("doc_id").alias("x"), F.col("v").alias("y")))
    star = store.keep(_star(posts, percent))
    ids = store.keep(star.select(F.explode(F.array("x", "y")).alias("v")).distinct())
    sets = sets_of(ids, docs, reps, n, store)
    links = links.unionByName(store.keep(verified(star, sets, percent)))
    label = components(links, store)

    large = star.groupBy("y").agg(F.count("*").alias("m")).where(F.col("m") >= CLUSTER).select(F.col("y").alias("g"))
    cluster = store.keep(star.join(large, F.col("y") == F.col("g")).select(F.col("x").alias("v"), "g").join(large.select(F.col("g").alias("v")), "v", "left_anti").unionByName(large.select(F.col("g").alias("v"), "g")))
    own = store.keep(posts.join(label, "v", "left").withColumn("c", F.coalesce("c", "v")).join(cluster, "v", "left"))
    members = cluster.join(label, "v", "left").select("v", "g", F.coalesce("c", "v").alias("c"))
    sizes = store.keep(members.groupBy("g").agg(F.count("*").alias("m"), F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("g", "m"))
    inner = store.keep(within_clusters(members, sizes, sets, percent))
    store.drop(ids, sets)

    pairs = store.keep(_across(own, percent))
    ids = store.keep(pairs.select(F.explode(F.array("x", "y")).alias("v")).distinct())
    sets = sets_of(ids, docs, reps, n, store)
    links = links.unionByName(inner).unionByName(store.keep(verified(pairs, sets, percent)))
    label = components(links, store)
    store.drop(own, pairs, ids, sets, cluster, sizes)
    store.drop(posts)
    named = store.keep(reps.select("key", "v").join(label, "v", "left").select("key", F.coalesce("c", "v").alias("c")))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), "key").join(named, "key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose doc_id is their component's smallest, with all their columns; of rows that repeat a doc_id, one. A null doc_id stays."""
    found = Store(docs.sparkSession).keep(jaccard_components(docs, n, percent).select("doc_id", "component_id"))
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    one = kept.join(again, "doc_id", "left_semi").select(docs.columns).groupBy(F.col("doc_id").alias("k")).agg(F.min_by(F.struct(docs.columns), F.xxhash64(F.coalesce("text", F.lit("")))).alias("r")).select("r.*")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and components of every row of ``documents``: three words, similarity 0.9."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90)
