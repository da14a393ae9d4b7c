"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

Binary codes: principal axes of a bounded sample, turned by rotations learnt by iterative quantisation
from several starts; a code of 64 bits a rotation. Tables: each code is cut into strings of ``w`` bits,
and vectors that agree in a string meet; ``w`` grows with the logarithm of the number of vectors, so a
table's buckets keep their size, and there are so many tables that a pair at the threshold meets with a
probability of ``RECALL`` or more. Met pairs whose codes are near are reranked with the vectors in double
precision.

Groups of copies never expand into rows of pairs. Exact copies are one vertex with a count. A first
round links each vector with the leader of one of its buckets; components of those links count their
own links by block-wise matrix products; pairs that met across two components are reranked one by one.

Edge cases: a vector that is null, empty, zero, or has null or non-finite components links with nothing;
so does a row with a null vec_id, which has no component and is not kept; vectors of different lengths
never link; repeated rows are copies, and count as other vectors; a cosine equal to the threshold links; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._common import Store, in_arrow, partitions, prepare, table
from assayer.llm.components import components

COSINE = 0.95
#: Vectors that the quantiser is fitted on: those with the smallest hashes of their ids.
SAMPLE = 20_000
BITS = 64
#: Chance that a pair at the threshold meets in a table, for independent bits.
RECALL = 0.995
#: Binary logarithm of the vectors of a bucket, on average.
BUCKET = 6
#: Least and most vectors of a side of a block of pairs; in between, so many times the root of the component's size, so that
#: blocks are many where there is work to share and copies of rows grow with the power 1.5 of the size.
BLOCK, MOST_BLOCK, BLOCK_ROOTS = 128, 2048, 4
_ITERATIONS = 30


class Quantiser:
    """Rotations (dim x bits each); ``width``: bits of a table's string. Axes are those of the directions
    about the origin, not about their mean: the angles that the cosine measures stay, even if all vectors are alike."""

    def __init__(self, sample: np.ndarray, vectors: int, cosine: float = COSINE, seed: int = 7):
        x = sample.astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        self.bits = min(BITS, x.shape[1])
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, : self.bits]
        z = x @ axes
        self.width = min(self.bits, max(8, math.ceil(math.log2(max(vectors, 2))) - BUCKET))
        agree = (1 - math.acos(cosine) / math.pi) ** self.width
        tables = math.ceil(math.log(1 - RECALL) / math.log1p(-agree))
        self.codes = -(-tables // (self.bits // self.width))
        rng = np.random.default_rng(seed)
        self.maps = []
        for _ in range(self.codes):
            r = np.linalg.qr(rng.standard_normal((self.bits, self.bits)))[0]
            for _ in range(_ITERATIONS):
                u, _, v = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
                r = (u @ v).T
            self.maps.append(axes @ r)
        #: Codes of a pair at the threshold differ in more bits than this about once in 30,000 times.
        total, p = self.bits * self.codes, math.acos(cosine) / math.pi
        self.radius = math.ceil(total * p + 4 * math.sqrt(total * p * (1 - p)) * (1 + math.log2(self.codes)) ** 0.5)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows x codes) of vectors, as 64-bit integers."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        place = np.uint64(1) << np.arange(self.bits, dtype=np.uint64)
        return np.stack([((x @ m >= 0) * place).sum(1, dtype=np.uint64) for m in self.maps], 1).view(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, each divided by its largest component, so that squares neither vanish nor overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return x / np.abs(x).max(1, keepdims=True) if len(x) else x


def _encode(quantiser: Quantiser, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = quantiser.encode(_matrix(b.column(1), dim))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(codes), pa.list_(pa.int64()))], names=["v", "codes"])

    return run


def _rerank(dim: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column(2), dim), _matrix(b.column(3), dim)
                cos = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                b = b.filter(pa.array(cos >= cosine))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"])

    return run


def _block_links(dim: int, cosine: float):
    """Rows sorted by (c, i, j): c, i, j, side, v, copies, embedding. A block pair at a time."""

    def links(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        v, side, copies = t["v"].to_numpy(), t["side"].to_numpy(), t["copies"].to_numpy()
        x = _matrix(t["embedding"].combine_chunks(), dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if i == j:
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            found = near @ copies
        else:
            a, b = side == i, side == j
            near = x[a] @ x[b].T >= cosine
            found = np.zeros(len(v), np.int64)
            found[a], found[b] = near @ copies[b], near.T @ copies[a]
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(found.astype(np.int64))], names=["v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[s].tolist())
                if last is not None and key != last:
                    yield from links(held)
                    held = []
                held.append(b.slice(s, e - s))
                last = key
        if held:
            yield from links(held)

    return run


def _met(posts: DataFrame, quantiser: Quantiser, a: str, b: str) -> F.Column:
    bits = sum((F.bit_count(F.col(f"{a}.codes")[k].bitwiseXOR(F.col(f"{b}.codes")[k])) for k in range(quantiser.codes)), F.lit(0))
    return bits <= quantiser.radius


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    prepare(spark)
    store = Store(spark)
    e = F.col("embedding")
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("ok", usable)
    rows = rows.select("vec_id", "ok", F.when(F.col("ok"), e).alias("embedding"))
    rows = rows.withColumn("key", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: F.xxhash64(x).cast("string")), F.size("embedding").cast("string")), 256)))
    good = rows.where("ok")
    reps = store.keep(good.groupBy("key").agg(F.min("vec_id").alias("v"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    dims = [r[0] for r in reps.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]
    links, counts = [], []
    for dim in dims:
        own = reps if len(dims) == 1 else reps.where(F.size("embedding") == dim)
        found, n = _links(own, dim, cosine, store)
        links.append(found)
        counts.append(n)
    if not dims:
        empty = spark.createDataFrame([], "v long, n long")
        links, counts = [empty.select(F.col("v").alias("x"), F.col("n").alias("y"))], [empty]
    every, n = links[0], counts[0]
    for a, b in zip(links[1:], counts[1:], strict=True):
        every, n = every.unionByName(a), n.unionByName(b)
    repeated = good.groupBy("vec_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("vec_id")
    same = store.keep(good.join(repeated, "vec_id", "left_semi").select("vec_id", "key").distinct().join(reps.select("key", "v"), "key").select(F.col("vec_id").alias("x"), F.col("v").alias("y")))
    label = components(every.unionByName(same), store)
    n = n.groupBy("v").agg(F.sum("n").alias("n"))
    named = store.keep(reps.select("key", "v", "copies").join(n, "v", "left").join(label, "v", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("c", "v").alias("c")))
    return (
        rows.select("vec_id", "key")
        .join(named, "key", "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def _links(reps: DataFrame, dim: int, cosine: float, store: Store) -> tuple[DataFrame, DataFrame]:
    """Links (x, y) that connect what all links connect, and the numbers (v, n) of linked rows, over distinct vectors of one length."""
    spark = reps.sparkSession
    sample = reps.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    quantiser = Quantiser(_matrix(sample, dim), reps.count(), cosine)
    codes = store.keep(in_arrow(reps.select("v", "embedding"), _encode(quantiser, dim), "v long, codes array<long>"))
    per = quantiser.bits // quantiser.width
    strings = [
        F.struct(F.lit(c * per + k).alias("t"), F.shiftrightunsigned(F.col("codes")[c], k * quantiser.width).bitwiseAND(F.lit((1 << quantiser.width) - 1)).alias("s"))
        for c in range(quantiser.codes)
        for k in range(per)
    ]
    posts = codes.select("v", "codes", F.explode(F.array(*strings)).alias("p")).select("p.t", "p.s", "v", "codes")

    def rerank(pairs: DataFrame) -> DataFrame:
        one = reps.select(F.col("v").alias("x"), F.col("embedding").alias("a"))
        two = reps.select(F.col("v").alias("y"), F.col("embedding").alias("b"))
        return in_arrow(pairs.select("x", "y").join(one, "x").join(two, "y").select("x", "y", "a", "b"), _rerank(dim, cosine), "x long, y long")

    leaders = posts.groupBy("t", "s").agg(F.min(F.struct("v", "codes")).alias("l"), F.count("*").alias("k")).where("k > 1").select("t", "s", F.col("l.v").alias("y"), F.col("l.codes").alias("codes"))
    p, q = posts.alias("p"), leaders.alias("q")
    star = p.join(q, (F.col("p.t") == F.col("q.t")) & (F.col("p.s") == F.col("q.s")) & (F.col("p.v") != F.col("q.y")) & _met(posts, quantiser, "p", "q"))
    star = store.keep(star.groupBy(F.col("p.v").alias("x")).agg(F.min("q.y").alias("y")))
    first = store.keep(rerank(star))
    label = components(first, store)

    named = store.keep(codes.join(label, "v", "left").select("v", "codes", F.coalesce("c", "v").alias("c")))
    posts = named.select("v", "codes", "c", F.explode(F.array(*strings)).alias("p")).select("p.t", "p.s", "v", "codes", "c")
    parts = posts.groupBy("t", "s", "c").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("t", "s").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("t", "s", F.col("m.c").alias("main"))
    met = posts.join(mixed, ["t", "s"]).withColumn("rest", F.col("c") != F.col("main"))
    p, q = met.where("rest").alias("p"), met.alias("q")
    across = p.join(
        q,
        (F.col("p.t") == F.col("q.t")) & (F.col("p.s") == F.col("q.s")) & (F.col("p.c") != F.col("q.c")) & (~F.col("q.rest") | (F.col("p.v") < F.col("q.v"))) & _met(posts, quantiser, "p", "q"),
    )
    across = store.keep(across.select(F.least("p.v", "q.v").alias("x"), F.greatest("p.v", "q.v").alias("y")).distinct())
    second = store.keep(rerank(across))

    sizes = named.join(label.select("v"), "v", "left_semi").groupBy("c").agg(F.count("*").alias("m"))
    members = named.select("v", "c").join(sizes, "c").withColumn("blocks", F.ceil(F.col("m") / F.least(F.lit(float(MOST_BLOCK)), F.greatest(F.lit(float(BLOCK)), BLOCK_ROOTS * F.sqrt("m"))))).withColumn("side", F.pmod(F.xxhash64("v"), F.col("blocks")))
    blocks = members.select("c", "v", "side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")).select("c", "v", "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"))
    blocks = blocks.join(reps.select("v", "copies", "embedding"), "v").select("c", "i", "j", "side", "v", "copies", "embedding")
    inner = in_arrow(blocks.repartition(partitions(spark), "c", "i", "j").sortWithinPartitions("c", "i", "j"), _block_links(dim, cosine), "v long, n long")
    copies = reps.select("v", "copies")
    outer = second.join(copies.withColumnRenamed("v", "y"), "y").select(F.col("x").alias("v"), F.col("copies").alias("n")).unionByName(second.join(copies.withColumnRenamed("v", "x"), "x").select(F.col("y").alias("v"), F.col("copies").alias("n")))
    return first.unionByName(second), store.keep(inner.unionByName(outer).groupBy("v").agg(F.sum("n").alias("n")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every row of ``embeddings``: cosine 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
