"""The operators' queries on the smallest tables: against their SQL, and their columns and rows."""

import os

import duckdb
import pytest

from assayer.llm import langid, masked_lm, ngram_join, packing, quality, sentencepiece_codec
from assayer.llm import queries as Q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")

#: Of each query its table, key, and the columns that it gives at least.
COLUMNS = {
    "op1_sentencepiece": ("documents", "doc_id", {"n_ids", "ids", "round_trip"}),
    "op2_masked_lm": ("documents", "doc_id", {"n_words", "log_likelihood", "per_word"}),
    "op3_ngram_jaccard_join": ("documents", "doc_id", {"n_shingles", "component_id"}),
    "op4_chat_formatting": ("conversations", "conv_id", {"roles", "texts", "chat"}),
    "op5_language_id": ("documents", "doc_id", {"held_out", "lang_pred", "score"}),
    "op6_html_extraction": ("pages", "page_id", {"url", "text", "n_chars"}),
    "op7_embedding_near_dedup": ("embeddings", "vec_id", {"n_links", "component_id", "kept"}),
    "op8_quality_rules": ("documents", "doc_id", {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}),
    "op9_best_fit_packing": ("documents", "doc_id", {"piece", "start", "length", "ids_crc32", "sequence_id", "offset"}),
    "op11_fill_in_middle": ("documents", "doc_id", {"n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"}),
    "op13_order_packing": ("documents", "doc_id", {"start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}),
    "op10_url_filters": ("pages", "page_id", {"host", "path", "rule", "verdict"}),
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, db, name):
    got, expected = Q.QUERIES[name](spark, DIR), db.execute(Q.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(c[0] for c in expected.description)
    assert sorted(map(repr, got.select(*names).collect())) == sorted(repr(spark_row(names, r)) for r in expected.df()[names].astype(object).itertuples(index=False))


def spark_row(names, values):
    from pyspark.sql import Row

    return Row(**{n: None if v is None or v != v else v for n, v in zip(names, values, strict=True)})


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_whole_tables(spark, name):
    source, key, columns = COLUMNS[name]
    got = Q.QUERIES[name](spark, DIR)
    assert columns <= set(got.columns)
    ids = spark.read.parquet(f"{DIR}/{source}.parquet").select(key)
    assert got.select(key).distinct().count() == ids.distinct().count()
    if name not in ("op4_chat_formatting", "op9_best_fit_packing", "op13_order_packing"):
        assert got.count() == ids.count()


CLASHES = ["n_ids", "ids", "score", "log_likelihood", "per_word", "n_words", "held_out", "lang_pred", "key", "v", "c", "component_id", "kept", "piece", "length", "salt", "rank", "good", "h", "r"]


def test_columns_of_the_input_do_not_clash(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"word{i} and other words of number {i} " * 9, "en", "s") for i in range(12)] + [(12, None, None, None)], "doc_id long, text string, lang string, source string")
    odd = docs.select("*", *(F.lit("x").alias(c) for c in CLASHES))
    ids = spark.range(4).select(F.col("id").alias("doc_id"))

    def runs(d):
        return {
            "op1": sentencepiece_codec.encode_documents(d),
            "op2": masked_lm.pseudo_likelihood(d).select("doc_id", "n_words", F.bround("log_likelihood", 2).alias("l")),
            "op3": ngram_join.jaccard_components(d),
            "op5": langid.language_id(d).select("doc_id", "held_out", "lang_pred"),
            "op8": quality.quality_rules(d, ids),
            "op9": packing.best_fit_packing(d),
        }

    for (name, a), b in zip(runs(docs).items(), runs(odd).values(), strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name
    assert quality.keep_good_documents(odd, ids).columns == odd.columns and ngram_join.keep_one_of_each_group(odd).columns == odd.columns
