"""Connected components of a link table, by contraction.

Every round hooks each vertex to its smallest neighbour, follows those pointers twice, relabels the
links and drops the ones inside a component. Rounds grow as the logarithm of the longest path. Only
narrow rows move, and each round's tables are written, so that a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._common import Store


def components(links: DataFrame, store: Store) -> DataFrame:
    """(v, c) for every vertex of ``links`` (x, y): c is the smallest vertex that v reaches.

    Links of a vertex with itself and repeated links change nothing; null ends are dropped.
    """
    e = store.keep(links.where("x IS NOT NULL AND y IS NOT NULL AND x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    label = store.keep(e.select(F.explode(F.array("x", "y")).alias("v")).distinct().select("v", F.col("v").alias("c")))
    old: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select("x", "y").unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hook = store.keep(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("p")))
        far = hook
        for _ in range(2):
            h = far.select(F.col("x").alias("p"), F.col("p").alias("q"))
            far = far.join(h, "p", "left").select("x", F.coalesce("q", "p").alias("p"))
        far = store.keep(far)
        old += [e, label, hook, far]
        label = store.keep(label.join(far.withColumnRenamed("x", "c"), "c", "left").select("v", F.coalesce("p", "c").alias("c")))
        e = store.keep(
            e.join(far.select(F.col("x"), F.col("p").alias("a")), "x", "left")
            .join(far.select(F.col("x").alias("y"), F.col("p").alias("b")), "y", "left")
            .select(F.coalesce("a", "x").alias("a"), F.coalesce("b", "y").alias("b"))
            .where("a <> b")
            .select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
            .distinct()
        )
    store.drop(*old, e)
    return label
