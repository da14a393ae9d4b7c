"""Runs: run records in Markdown, a JSON array, or a table.

RUN rows: source, ord, arm, seed, status, metrics (map of doubles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import parsing
from assayer.functions.text import once, to_double, to_long, unquote
from assayer.sources.notes import read_texts

_JSON = "arm string, seed string, status string, metrics map<string,string>"


def runs_from_texts(texts: DataFrame) -> DataFrame:
    """Runs of rows (rel, text): records without front matter, arm or a whole seed are left out. Files are in order of their names.

    A value keeps a comment that follows it (``status: ok  # or oom`` is no ``ok``); ``commented`` names the keys of such values.
    """
    raw = parsing.open_front_matter(F.regexp_replace(F.make_valid_utf8("text"), "\r\n?", "\n"))
    m = once(once(texts, "rel", raw.alias("raw")), "rel", parsing.fields(F.col("raw"), comments=False).alias("f")).where("f IS NOT NULL")
    get = lambda k, default=None: F.coalesce(F.try_element_at("f", F.lit(k)), F.lit(default))
    return once(
        m,
        F.col("rel").alias("source"),
        F.col("rel").alias("ord"),
        unquote(get("arm")).alias("arm"),
        to_long(get("seed")).alias("seed"),
        unquote(get("status", "ok")).alias("status"),
        parsing.metrics(get("metrics", "")).alias("metrics"),
        parsing.commented(F.col("f"), "arm", "seed", "status").alias("commented"),
    ).where("arm IS NOT NULL AND seed IS NOT NULL")


def read_markdown_runs(spark: SparkSession, path: str) -> DataFrame:
    return runs_from_texts(read_texts(spark, path, recursive=False))


def _json_number(c: Column) -> Column:
    return F.when(F.lower(c) == "true", 1.0).when(F.lower(c) == "false", 0.0).otherwise(to_double(c))


def read_json_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a JSON array. Seeds and metrics may be strings or booleans; a run without arm or seed, or with a metric that is no number, raises an error when it is read."""
    rows = spark.read.schema(_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("ord", F.monotonically_increasing_id())
    need = lambda c, what: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"run without {what}")))
    seed = F.coalesce(to_long(F.col("seed")), F.floor(_json_number(F.regexp_replace("seed", r"\..*$", ""))).cast("long"))
    return rows.select(
        F.lit(path).alias("source"),
        "ord",
        need(F.col("arm"), "arm").alias("arm"),
        need(seed, "seed").alias("seed"),
        F.coalesce("status", F.lit("ok")).alias("status"),
        F.transform_values(F.coalesce("metrics", F.create_map().cast("map<string,string>")), lambda _, v: need(_json_number(v), "a number as its metric")).alias("metrics"),
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a folder of records or a JSON file; ValueError if there is neither, or no run."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        raise ValueError(f"{path}: no such file or folder")
    runs = read_markdown_runs(spark, path) if fs.getFileStatus(top).isDirectory() else read_json_runs(spark, path)
    if runs.isEmpty():
        raise ValueError(f"{path}: no runs")
    return runs


def runs_from_table(df: DataFrame, arm: str, seed: str, order: str, metrics: dict[str, str], status: Column | None = None) -> DataFrame:
    """Any table as runs: columns that name the arm, the seed, the order and the metrics."""
    return df.select(
        F.lit("table").alias("source"),
        F.col(order).alias("ord"),
        F.col(arm).alias("arm"),
        F.col(seed).cast("long").alias("seed"),
        (F.lit("ok") if status is None else status).alias("status"),
        F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*(F.col(c).cast("double") for c in metrics.values()))).alias("metrics"),
    )
