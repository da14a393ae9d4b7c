"""Run records as a stream: each batch of new files updates the table of runs and recomputes the report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.sources.runs import runs_from_texts


def stream_runs(spark: SparkSession, path: str) -> DataFrame:
    """A streaming DataFrame of the runs in a folder, one file a record."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").load(path)
    return runs_from_texts(files.select(F.regexp_extract("path", "[^/]*$", 0).alias("rel"), F.col("content").cast("string").alias("text")))


def keep_runs(spark: SparkSession, path: str, table: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    """Appends new runs to a Parquet table (a batch replaces its own part, so a retry adds nothing twice) and calls ``then`` on all runs so far."""

    def batch(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={k}")
        if then:
            then(spark.read.parquet(table).drop("batch"))

    return stream_runs(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
