"""Notes: a directory tree of Markdown files, or any table with a path and a text.

NOTE rows: vault, rel, dir, stem, fm_raw, body, fm (map), type, links (array).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import parsing
from assayer.functions.text import last_component, once, stem, without_md


def notes_from_texts(texts: DataFrame) -> DataFrame:
    """Notes of rows (vault, rel, text). Line ends become \\n, invalid UTF-8 becomes U+FFFD."""
    text = F.regexp_replace(F.make_valid_utf8(F.coalesce("text", F.lit(""))), "\r\n?", "\n")
    rows = once(texts.where(~F.col("rel").startswith(".obsidian/")), "vault", "rel", text.alias("text"))
    rows = once(rows, "vault", "rel", parsing.front_matter(F.col("text")).alias("fm_raw"), parsing.body(F.col("text")).alias("body"))
    rows = once(rows, "vault", "rel", F.regexp_replace("rel", "/?[^/]*$", "").alias("dir"), stem(F.col("rel")).alias("stem"), "fm_raw", "body", parsing.fields(F.col("fm_raw")).alias("fm"))
    return rows.withColumns({"links": parsing.links(F.col("body")), "type": F.coalesce(F.try_element_at("fm", F.lit("type")), F.lit(""))})


def _hidden(spark: SparkSession, path: str, recursive: bool) -> tuple[list[str], list[str]]:
    """What Spark's scans skip: folders whose own names begin with _ or a dot, and Markdown files whose names do.

    The file system matches names level by level, so that only what is skipped comes to the driver's Python, and a level's number of entries.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    level = re.sub(r"([\\*?\[\]{}])", r"\\\1", fs.getFileStatus(top).getPath().toString().rstrip("/"))
    matching = lambda pattern: fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or []
    folders, files = [], []
    while True:
        for status in matching(f"{level}/{{_*,.*}}"):
            name = status.getPath().getName()
            if name.startswith("_") and "=" in name:
                continue
            if status.isDirectory() and recursive:
                folders.append(status.getPath().toString())
            elif status.isFile() and name.endswith(".md"):
                files.append(status.getPath().toString())
        level += "/*"
        if not recursive or not len(matching(level)):
            return folders, files


def content(spark: SparkSession, file: str) -> bytearray:
    """The bytes of one file, read by the driver."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_texts(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(rel, text) of the Markdown files below a folder, those included whose names Spark would skip.

    Tasks read the contents, of skipped folders too, which are scanned as folders of their own. Only files whose own names
    are skipped (a vault has one or two) are read by the driver, as no scan of Spark's gives them.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(top).getPath().toUri().getPath().rstrip("/")
    folders, files = _hidden(spark, path, recursive)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load([path, *folders]).select("path", "content")
    if files:
        rows = rows.unionByName(spark.createDataFrame([(f, content(spark, f)) for f in files], "path string, content binary"))
    name = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return rows.select(F.substring(name, F.lit(len(base) + 2), F.length(name)).alias("rel"), F.col("content").cast("string").alias("text"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(rel) of all files below a folder, whatever their kind, but for those that Spark skips; nothing is read."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(top).getPath().toUri().getPath().rstrip("/")
    name = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([path, *_hidden(spark, path, True)[0]]).select("path")
    return rows.select(F.substring(name, F.lit(len(base) + 2), F.length(name)).alias("rel"))


def read_notes(spark: SparkSession, path: str, vault: str | None = None) -> DataFrame:
    """All notes of a vault."""
    return notes_from_texts(read_texts(spark, path).withColumn("vault", F.lit(vault or path)))


def edges(notes: DataFrame) -> DataFrame:
    """(vault, src, type, link, target, name): a row for each distinct wikilink of a note."""
    rows = notes.select("vault", F.col("rel").alias("src"), "type", F.explode("links").alias("link"))
    return rows.withColumn("target", without_md(F.col("link"))).withColumn("name", last_component(F.col("target")))
