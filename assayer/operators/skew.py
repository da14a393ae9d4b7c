"""Joins in which one key may hold a great part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that hold more rows than a partition has on average: at most as many keys as there are shuffle partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.join(F.broadcast(total), F.col("_n") * parts > F.col("_all")).select(*keys)  # one row on the right


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", counts: str | None = None) -> DataFrame:
    """``rows.join(table, keys, how)`` for ``how`` inner or left and a ``table`` with one row a key.

    Rows of hot keys stay where they are: their few lines of ``table`` are broadcast, at most one for each shuffle
    partition. All others meet by a shuffle. Null keys meet nothing. ``rows`` is read once more to count keys, unless
    ``counts`` names a column of ``table`` that has the number of rows of its key (it is left out of the result).
    """
    if counts:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = F.broadcast(table.agg(F.sum(counts).alias("_all")))  # one row
        found = table.join(total, F.col(counts) * parts > F.col("_all")).select(*keys)
        table = table.drop(counts)
    else:
        found = hot_keys(rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), keys)
    hot = F.broadcast(found.withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, keys, "left")
    few = table.join(hot, keys, "left_semi")
    near = marked.where("_hot").drop("_hot").join(F.broadcast(few), keys, how)
    return near.unionByName(marked.where("_hot IS NULL").drop("_hot").join(table, keys, how))
