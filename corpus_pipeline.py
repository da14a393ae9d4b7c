"""A corpus pipeline: quality rules, language ID, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; its decisions
take effect. All but the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm._common import Store, table
from assayer.llm.langid import keep_known_languages
from assayer.llm.ngram_join import keep_one_of_each_group
from assayer.llm.packing import best_fit_packing
from assayer.llm.quality import keep_good_documents, trusted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a base rule or the likelihood ratio rejects."""
    return keep_good_documents(docs, trusted(spark, sf_dir))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in none of the learned languages."""
    return keep_known_languages(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five words, similarity 0.8."""
    return keep_one_of_each_group(docs, n=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return best_fit_packing(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", ngram_jaccard_join), ("best-fit packing", packing)]

#: SQL can express neither the fitted models nor the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
