"""Quality rules: base statistics of a text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed character n-grams (1 to 3) are counted: one over all documents (raw), one
over trusted ones (labelled quality 1). A document's score is the mean over its n-grams of
log p_trusted - log p_raw; it is kept if no base rule fails and the score reaches ``THRESHOLD``.

Edge cases: a null or empty text has no words, so the base rule on word counts fails it; a text without
n-grams scores 0; texts of any length are read whole, in blocks; a score equal to the threshold is kept;
repeated rows are judged each; without trusted documents every score is 0, and only
base rules decide; an empty table gives an empty result; other columns are never read, but
``keep_good_documents`` passes them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._common import Store, in_arrow, prepare, table, windows, word_hashes

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 15
#: Trusted ids up to which they are broadcast; more are joined by a shuffle. Both counts cover all documents either way.
BROADCAST_IDS = 1_000_000
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.2
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
MIN_WORDS = 20
WINDOW = 8
_BLOCK = 1 << 20

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.bool_()]


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's character n-grams of 1, 2 and 3 code points, in blocks."""
    for at in range(0, len(text), _BLOCK):
        c = np.frombuffer(text[at : at + _BLOCK + 2].encode("utf-32-le", "replace"), "<u4")
        with np.errstate(over="ignore"):
            one = c * np.uint32(2654435761)
            two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[1:]
            three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(668265263) + c[2:]
            parts = one[:_BLOCK], (two * np.uint32(3266489917))[:_BLOCK], (three * np.uint32(2654435769))[:_BLOCK]
        yield np.concatenate(parts) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target, seen = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), False
    for b in batches:
        for good, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for g in grams(text or ""):
                n = np.bincount(g, minlength=BUCKETS) if len(g) > 4096 else None
                for counts in (raw, target) if good else (raw,):
                    if n is None:
                        np.add.at(counts, g, 1)
                    else:
                        counts += n
        seen = True
    if seen:
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 8192):
            k = at[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(raw[k]), pa.array(target[k])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, trusted_ids: DataFrame) -> np.ndarray:
    """log p_trusted - log p_raw of each bucket. ``trusted_ids``: doc_id of trusted documents."""
    prepare(docs.sparkSession)
    ids = Store(docs.sparkSession).keep(trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("good", F.lit(True)))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left").select("good", "text")
    sums = in_arrow(marked, _count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = sums.collect()  # at most BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts:
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def repeated_words(words: np.ndarray, n: int = WINDOW) -> int:
    """Of hashes of words: how many lie in an n-word window found twice or more in the text, the first one included."""
    if len(words) <= n:
        return 0
    h = windows(words, n)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edges[at] += 1
    np.add.at(edges, at + n, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_statistics(text: str | None, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. ``words``: hashes of the text's words."""
    text = text or ""
    seen: set[str] = set()
    doubled = 0
    for line in text.split("\n"):
        if line in seen:
            doubled += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), doubled, repeated_words(words)


def judge(text: str | None, words: np.ndarray, ratios: np.ndarray) -> tuple[int, int, int, int, int, bool, float, bool]:
    base = base_statistics(text, words)
    total, n = 0.0, 0
    for g in grams(text or ""):
        total += float(ratios[g].sum())
        n += len(g)
    score = total / n if n else 0.0
    failed = base[0] < MIN_WORDS or 100 * base[4] > 30 * base[0]
    return (*base, failed, score, not failed and score >= THRESHOLD)


def _judge(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [judge(x, h, ratios) for x, h in zip(texts, word_hashes(texts), strict=True)]
            columns = [b.column(0), *([r[i] for r in rows] for i in range(8))]
            yield pa.RecordBatch.from_arrays([c if i == 0 else pa.array(c, t) for i, (c, t) in enumerate(zip(columns, _TYPES, strict=True))], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def _keep(ratios: np.ndarray, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            yield b.filter(pa.array([judge(x, h, ratios)[-1] for x, h in zip(texts, word_hashes(texts), strict=True)], pa.bool_()))

    return run


def quality_rules(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """One row per document: base statistics, base_failed, score, kept."""
    ratios = log_ratios(docs, trusted_ids)
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _judge(ratios), RESULT)


def keep_good_documents(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    ratios = log_ratios(docs, trusted_ids)
    return in_arrow(docs, _keep(ratios, docs.columns.index("text")), docs.schema)


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every row of ``documents``, with the labelled ones of quality 1 as trusted."""
    return quality_rules(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))
