"""Connected components of links, by alternating stars.

Vertices are of any type that Spark orders. A large star links each larger neighbour of a vertex to the smallest one
that the vertex sees, a small star does so with the smaller neighbours; both in turn until every link leads to the
smallest vertex of its component. The rounds are few (about the logarithm of the longest path), each is one
aggregation and one join, in which vertices of many links are split, and each is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.skew import look_up
from assayer.sources.written import Rounds


def _star(links: DataFrame) -> DataFrame:
    """Links (x, y) with x > y, each vertex's larger neighbours moved to its smallest neighbour or itself."""
    both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n")
    return look_up(both.where("y > x"), least, ["x"], counts="n").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links (x, y) with x > y, each vertex and its smaller neighbours moved to the smallest of them."""
    least = links.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n"))
    moved = look_up(links, least, ["x"], counts="n").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.unionByName(least.select("x", F.col("m").alias("y"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, c) for every vertex of ``links`` (x, y): c is the smallest vertex that v reaches, itself included.

    Links of a vertex to itself and repeated ones change nothing; a link with a null end is none. Vertices without a
    link are not listed. Runs its rounds when called.
    """
    store = Rounds(links.sparkSession)
    now = store.keep(links.where("x IS NOT NULL AND y IS NOT NULL AND x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    while True:
        # done once every vertex with a link has one centre, which has no link itself
        centres = now.select(F.col("y").alias("x")).distinct().withColumn("centre", F.lit(True))
        if now.groupBy("x").agg(F.count("*").alias("n")).join(centres, "x", "left").where("n > 1 OR centre").isEmpty():
            centres = now.select(F.col("y").alias("v")).distinct()
            return now.select(F.col("x").alias("v"), F.col("y").alias("c")).unionByName(centres.select("v", F.col("v").alias("c")))
        large = store.keep(_star(now))
        then = store.keep(_small_star(large))
        store.drop(now, large)
        now = then
