"""Language ID with string kernels.

The kernel of two texts counts the character n-grams (1 to 3, lower-cased, hashed) that both have,
divided by the geometric mean of their own numbers: a blended-spectrum presence kernel. Landmarks give
a Nyström map, x -> k(x, landmarks) K^(-1/2); a kernel ridge regression per language, one against the
rest, is fitted on the mapped training texts. A batch of texts is scored by two matrix products.

The fit takes at most ``TRAINING`` labelled rows (one of each language, if there are more languages),
those with the smallest hashes of their ids within each language, and whole texts; prediction covers
all rows.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is every text if no row is
labelled; texts of any length are read whole, in blocks; of languages with equal scores the first by
name is predicted; of rows that repeat an id and a language the smallest text is learned from; repeated
rows are scored each; an empty table gives an empty result; lang, source, doc_id and
other columns are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm._common import in_arrow, prepare, table

UNDETERMINED = "und"
#: Most labelled rows of a fit, over all languages, and landmarks; with more languages than that, one of each.
TRAINING = 2400
LANDMARKS = 192
#: Languages up to which their numbers of rows are broadcast.
MANY = 10_000
RIDGE = 1e-4
#: Buckets of 1-, 2- and 3-grams.
SIZES = (1 << 10, 1 << 12, 1 << 13)
WIDTH = sum(SIZES)
#: A document whose best score is lower is rejected by the pipeline.
MIN_SCORE = 0.3
_BLOCK = 1 << 20
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def presence(texts: list[str | None]) -> np.ndarray:
    """0/1 matrix: the n-gram buckets that each text has."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        text = (text or "").lower()
        for at in range(0, len(text), _BLOCK):
            c = np.frombuffer(text[at : at + _BLOCK + 2].encode("utf-32-le", "replace"), "<u4")
            with np.errstate(over="ignore"):
                one = c * np.uint32(2654435761)
                two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[1:]
                three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(668265263) + c[2:]
                base = 0
                for h, odd, size in ((one, 2654435761, SIZES[0]), (two, 3266489917, SIZES[1]), (three, 2654435769, SIZES[2])):
                    row[base + ((h * np.uint32(odd)) >> np.uint32(33 - size.bit_length()))] = 1
                    base += size
    return out


def unit(p: np.ndarray) -> np.ndarray:
    n = p.sum(1, keepdims=True)
    return p / np.sqrt(np.maximum(n, 1))


def has_letter(text: str | None) -> bool:
    """Whether the text has any Unicode letter."""
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # WIDTH x landmarks, unit presence vectors
    weights: np.ndarray  # landmarks x languages, with the Nyström map folded in
    bias: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Share of each language: one-versus-rest outputs, cut to 0..1."""
        return np.clip(unit(presence(texts)) @ self.landmarks @ self.weights + self.bias, 0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        at = [i for i, x in enumerate(texts) if self.langs and has_letter(x)]
        for k in range(0, len(at), 64):
            part = at[k : k + 64]
            y = self.scores([texts[i] for i in part])
            for i, row in zip(part, y, strict=True):
                langs[i], scores[i] = self.langs[int(row.argmax())], float(row.max())
        return langs, scores


def fit(texts: list[str], langs: list[str]) -> Model:
    """Landmarks are dealt to the languages in turn; targets are 1 for a language's own texts, 0 for others."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((WIDTH, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([[a == b for b in names] for a in langs], np.float64)
    x = unit(np.concatenate([presence(texts[i : i + 256]) for i in range(0, len(texts), 256)]))
    own = [np.flatnonzero(y[:, j]) for j in range(len(names))]
    chosen = [own[j][i] for i in range(max(map(len, own))) for j in range(len(names)) if i < len(own[j])][: max(LANDMARKS, len(names))]
    marks = x[chosen]
    k = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = (x @ marks.T) @ root
    mean, target = z.mean(0), y.mean(0)
    zc = z - mean
    w = np.linalg.solve(zc.T @ zc + RIDGE * len(z) * np.eye(z.shape[1]), zc.T @ (y - target))
    return Model(names, np.ascontiguousarray(marks.T, np.float32), (root @ w).astype(np.float32), (target - mean @ w).astype(np.float32))


def train(labelled: DataFrame) -> Model:
    """Fits on labelled rows (doc_id, text, lang): the same number of each language, by hash of the id."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    ids = rows.select("lang", "doc_id").distinct()
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    n = sizes.count()
    if not n:
        return fit([], [])
    each = max(1, TRAINING // n)
    # the smallest hashes only: four times as many as are wanted, so that few rows are ranked however many a language has
    share = (F.lit(4.0 * each + 100) / F.col("n")) * F.lit(2.0**64) - F.lit(2.0**63)
    least = ids.join(F.broadcast(sizes) if n <= MANY else sizes, "lang").withColumn("h", F.xxhash64("doc_id")).where(F.col("h").cast("double") <= share)
    least = least.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= each)
    found = least.select("lang", "doc_id").collect()  # at most TRAINING rows, or one for each language
    picked = F.broadcast(rows.sparkSession.createDataFrame(found, "lang string, doc_id long"))
    got = rows.join(picked, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").collect()
    usable = [r for r in got if has_letter(r["text"])]
    return fit([r["text"] for r in usable], [r["lang"] for r in usable])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = model.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _keep(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = model.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([n != UNDETERMINED and s >= MIN_SCORE for n, s in zip(langs, scores, strict=True)], pa.bool_()))

    return run


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Fits on the documents that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    prepare(docs.sparkSession)
    model = train(docs.where(~held_out()))
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")), _predict(model), RESULT)


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The documents in one of the learned languages, with all their columns: neither ``und`` nor below MIN_SCORE."""
    prepare(docs.sparkSession)
    model = train(docs.where(~held_out()))
    return in_arrow(docs, _keep(model, docs.columns.index("text")), docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every row of ``documents``, learned from those that are not held out."""
    return language_id(table(spark, sf_dir, "documents"))
