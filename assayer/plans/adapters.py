"""Adapters from star-schema tables to runs and notes.

Notes are rendered as Markdown texts from columns and then read by the real parsers, so that a result can
be held against SQL on the columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.notes import notes_from_texts
from assayer.sources.runs import runs_from_table

BASELINE = "5-LOW"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task renders, parses and keeps as notes (about 50 MB of them in the cache).
SPREAD_ROWS = 200_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table with too few splits, dealt out to all cores, and to more tasks than cores so that none gets more than
    about ``SPREAD_ROWS``: rendering and parsing cost more than the shuffle of a few columns, and notes are many times larger than
    their compressed rows. A table of enough splits stays as it is. The count is read from the files' footers."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SPREAD_ROWS))
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: an arm for each priority, seeds are customers, P counts as a failure."""
    status = F.when(F.col("o_orderstatus").isin("F", "O"), "ok").otherwise("skipped")
    return runs_from_table(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", "o_orderkey", {"price": "o_totalprice"}, status)


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: an arm for each type, seeds are users; events of value 0 or less count as a failure."""
    return runs_from_table(table(spark, sf_dir, "events"), "event_type", "user_id", "event_id", {"value": "value"}, F.when(F.col("value") > 1, "ok").otherwise("low"))


def text_of(key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def note(rel: Column, head: list[tuple[str, Column | str]], *body: Column | str) -> list[Column]:
    """Columns rel and text of a rendered note."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    lines = [F.concat(F.lit(f"{k}: "), lit(v)) for k, v in head]
    return [rel.alias("rel"), F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), *map(lit, body)).alias("text")]


def run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as run records; every seventh has no tags."""
    price = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    head = [
        ("type", "run"),
        ("id", F.concat(F.lit("r"), text_of("o_orderkey"))),
        ("arm", F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))),
        ("seed", text_of("o_custkey")),
        ("status", F.when(F.col("o_orderstatus") == "P", "skipped").otherwise("ok")),
        ("metrics", F.concat(F.lit("{price: "), price, F.lit(", size: "), text_of(F.col("o_orderkey") % 10), F.lit("e-1}"))),
        ("added", F.date_format("o_orderdate", "yyyy-MM-dd")),
    ]
    rel, text = note(F.concat(F.lit("runs/"), text_of("o_orderkey"), F.lit(".md")), head)
    tags = F.when(F.col("o_orderkey") % 7 == 0, text).otherwise(F.regexp_replace(text, r"\n---\n$", "\ntags: [run]\n---\n"))
    return spread(table(spark, sf_dir, "orders")).select(rel, F.concat(tags, F.lit("About [[c"), text_of("o_custkey"), F.lit("|the customer]] and [[c"), text_of("o_custkey"), F.lit("#x]].\n")).alias("text"))


def spec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as specs. A third of them has no digest, a third a wrong one."""
    head = [
        ("type", "spec"),
        ("id", F.concat(F.lit("s"), text_of("p_partkey"))),
        ("hypothesis", F.concat(F.lit('"'), "p_name", F.lit('   matters"  '))),
        ("arms", F.concat(F.lit("["), "p_brand", F.lit(", none]"))),
        ("baseline", "none"),
        ("dataset", F.concat(F.lit("{name: "), "p_type", F.lit("}"))),
        ("metrics", "[price]"),
        ("seeds", F.concat(F.lit("[0, 1, "), text_of("p_size"), F.lit("]"))),
        ("scale", "smoke"),
        ("spec_hash", F.when(F.col("p_partkey") % 3 == 0, '""').when(F.col("p_partkey") % 3 == 1, "0123456789abcdef").otherwise("@")),
        ("decision_rule", F.concat(F.lit("\n  metric: price\n  threshold: 0."), text_of("p_size"))),
        ("added", "2024-01-01"),
        ("tags", "[spec]"),
        ("title", "p_name"),
    ]
    rel, text = note(F.concat(F.lit("specs/"), text_of("p_partkey"), F.lit(".md")), head, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("## Decision rule\nprice  over 0."), text_of("p_size"), F.lit("\n\n## Design\nfree text\n"))).otherwise("Free text.\n"))
    return spread(table(spark, sf_dir, "part")).select(rel, text)


def ruled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as specs with a rule in the front matter, commented for every fifth, and one in the text, another for every third."""
    k, size = F.col("p_partkey"), text_of("p_size")
    comparator = F.when(k % 4 == 0, '">="').when(k % 4 == 1, "<").otherwise(">")
    rule = F.concat(F.lit("\n  metric: price\n  comparator: "), comparator, F.lit("\n  threshold: 0."), size, F.when(k % 5 == 0, "   # of the first sketch").otherwise(""), F.lit("\n  min_seeds: "), text_of(k % 9))
    fenced = F.concat(F.lit("Text.\n```yaml\ndecision_rule:\n  metric: price\n  comparator: "), comparator, F.lit("\n  threshold: 0."), F.when(k % 3 == 0, "7").otherwise(""), size, F.when(k % 5 == 0, "   # of the first sketch").otherwise(""), F.lit("\n  min_seeds: "), text_of(k % 9), F.lit("\n```\n"))
    rel, text = note(F.concat(F.lit("specs/"), text_of(k), F.lit(".md")), [("type", "spec"), ("id", F.concat(F.lit("s"), text_of(k))), ("decision_rule", rule)], fenced)
    return spread(table(spark, sf_dir, "part")).select(rel, text)


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source notes with a figure, and quotes that have it for three in four."""
    n = F.col("doc_id")
    figure = F.concat(text_of(n % 90 + 10), F.lit("."), text_of(n % 10))
    quote = F.when(n % 4 == 0, "> nothing to see\n").when(n % 11 == 0, "plain\n").otherwise(F.concat(F.lit("> a gain of "), figure, F.lit(" points\n  > and more\n")))
    head = [
        ("type", "source"),
        ("key", F.concat(F.lit("d"), text_of(n))),
        ("title", F.concat(F.lit("Document "), text_of(n))),
        ("read", F.when(n % 13 == 0, "unreachable").when(n % 3 == 0, "full").otherwise("partial")),
        ("raw", F.concat(F.lit("raw/d"), text_of(n), F.lit(".md"))),
        ("added", "2024-01-01"),
        ("tags", "[source]"),
    ]
    tail = F.when(n % 17 == 0, "").otherwise(F.concat(F.lit("## Evidence\n"), quote))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", *note(F.concat(F.lit("sources/d"), text_of(n), F.lit(".md")), head, F.concat(F.lit("## Results\nUp by "), figure, F.lit("% in 2024 and 15 %, see [[lang-"), "lang", F.lit("]].\n")), tail)).select("rel", "text")


def dossier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dossier for each document but every fifth, one more for every 19th that has no source note, and the screening record. Every seventh has no reading."""
    n = F.col("doc_id")
    docs = spread(table(spark, sf_dir, "documents"))
    head = lambda key: [("type", "dossier"), ("key", key), ("read", F.when(n % 7 == 0, "").when(n % 2 == 0, "full").otherwise("abstract-only")), ("tags", "[raw]")]
    own = docs.where(n % 5 != 0).select(*note(F.concat(F.lit("raw/d"), text_of(n), F.lit(".md")), head(F.concat(F.lit("d"), text_of(n))), "> quoted\n"))
    more = docs.where(n % 19 == 0).select(*note(F.concat(F.lit("raw/x"), text_of(n), F.lit(".md")), head(F.concat(F.lit("x"), text_of(n))), "> quoted\n"))
    screening = spark.createDataFrame([("_meta/screening.md", "# Screening\nexcluded: x0, x19 and x38\n")], "rel string, text string")
    return own.unionByName(more).unionByName(screening)


def claim_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as claims: supported if of quality, contradicted if toxic."""
    d = text_of("doc_id")
    head = [
        ("type", "claim"),
        ("title", F.concat(F.lit("Claim "), d)),
        ("status", F.when(F.col("doc_id") % 2 == 0, "settled").otherwise("open")),
        ("supported_by", F.when(F.col("quality") == 1, F.concat(F.lit("[d"), d, F.lit("]"))).otherwise("[]")),
        ("contradicted_by", F.when(F.col("toxic") == 1, F.concat(F.lit("[d"), d, F.lit("]"))).otherwise("")),
        ("tags", "[claim]"),
    ]
    return spread(table(spark, sf_dir, "labels")).select(*note(F.concat(F.lit("claims/"), d, F.lit(".md")), head, F.concat(F.lit("See [[d"), d, F.lit("]].\n"))))


def result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results that cite a customer's note and a seed's run; customers as concept notes, and nations, which nothing links; some seeds as runs."""
    k, c = text_of("o_orderkey"), text_of("o_custkey")
    results = spread(table(spark, sf_dir, "orders")).select(
        *note(F.concat(F.lit("results/"), k, F.lit(".md")), [("type", "result"), ("title", F.concat(F.lit("Result "), k)), ("added", "2024-01-01"), ("tags", "[result]")], F.concat(F.lit("On [[concepts/c"), c, F.lit(".md]] by [[exp-seed"), text_of(F.col("o_custkey") % 60), F.lit("]]"), F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit(" and [[Missing "), k, F.lit("]]"))).otherwise(""), F.lit(".\n")))
    )
    concepts = spread(table(spark, sf_dir, "customer")).select(*note(F.concat(F.lit("concepts/c"), text_of("c_custkey"), F.lit(".md")), [("type", "concept"), ("title", F.concat(F.lit("Customer "), text_of("c_custkey"))), ("added", "2024-01-01"), ("tags", "[concept]")], "A customer.\n"))
    alone = table(spark, sf_dir, "nation").select(*note(F.concat(F.lit("concepts/n"), text_of("n_nationkey"), F.lit(".md")), [("type", "concept"), ("title", F.col("n_name")), ("added", "2024-01-01"), ("tags", "[concept]")], F.concat(F.lit("# Nation\n\nNamed "), "n_name", F.lit(".\n"))))
    seeds = spark.range(40).select(*note(F.concat(F.lit("runs/exp-seed"), text_of("id"), F.lit(".md")), [("type", "run"), ("id", F.concat(F.lit("e"), text_of("id"))), ("arm", "a"), ("seed", text_of("id")), ("status", "ok"), ("added", "2024-01-01"), ("tags", "[run]")], "Measured.\n"))
    return results.unionByName(concepts).unionByName(alone).unionByName(seeds)


def as_notes(*texts: DataFrame) -> DataFrame:
    return notes_from_texts(reduce(DataFrame.unionByName, texts).withColumn("vault", F.lit("v")))
