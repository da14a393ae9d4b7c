"""Snowballing: following the citations that recur among the works collected so far, and saying where it stopped.

Rounds are semi-naive: each opens the reference lists of the last round's works only and adds their counts to those of the rounds before.
Every round's tables are written; nothing of them is collected but whether a round brought anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.skew import look_up
from assayer.sources.written import Rounds

#: Why a work's reference list was opened or not.
OPENED, LIMIT, RARE = "opened", "limit", "rare"


def snowball(citations: DataFrame, seeds: DataFrame, least: int = 2, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Works reached from ``seeds`` (work) over ``citations`` (src, ref), and the log of the rounds.

    A work is collected in the first round in which at least ``least`` collected works cite it. Works: work, depth (0 for seeds),
    n_citing (collected works whose lists were opened that cite it) and reason: ``opened``; ``limit`` if it came in the last round allowed, so that
    its list was not opened; ``rare`` with a null depth if it was cited, but by fewer than ``least``. Log: round, opened (works whose lists
    were read), cited (works known to be cited so far) and found (works that the round brought); it ends with the round that
    found nothing, or with the last one allowed.

    Repeated citations count once, a work that cites itself does not count, null ends are no citation; seeds that cite nothing stay.
    Runs its rounds when called.
    """
    spark = citations.sparkSession
    store = Rounds(spark)
    edges = store.keep(citations.where("src IS NOT NULL AND ref IS NOT NULL AND src <> ref").select(F.col("src").alias("work"), "ref").distinct())
    frontier = store.keep(seeds.where("work IS NOT NULL").select("work").distinct().withColumn("depth", F.lit(0)))
    collected, counts, log = [frontier], None, []
    for k in range(1, rounds + 1):
        fresh = look_up(edges, frontier.select("work"), ["work"]).groupBy("ref").agg(F.count("*").alias("n"))
        total = fresh if counts is None else counts.unionByName(fresh).groupBy("ref").agg(F.sum("n").alias("n"))
        counts = store.keep(total)
        known = collected[0]
        for part in collected[1:]:
            known = known.unionByName(part)
        opened = frontier
        frontier = store.keep(counts.where(F.col("n") >= least).select(F.col("ref").alias("work")).join(known.select("work"), "work", "left_anti").withColumn("depth", F.lit(k)))
        sizes = [t.agg(F.count("*").alias(name)) for t, name in ((opened, "opened"), (counts, "cited"), (frontier, "found"))]
        log.append(sizes[0].crossJoin(sizes[1]).crossJoin(sizes[2]).select(F.lit(k).alias("round"), "opened", "cited", "found"))  # rows of one
        if frontier.isEmpty():
            break
        collected.append(frontier)
    known = collected[0]
    for part in collected[1:]:
        known = known.unionByName(part)
    cited = counts if counts is not None else spark.createDataFrame([], edges.select("ref").schema).withColumn("n", F.lit(0))
    both = known.join(cited.withColumnRenamed("ref", "work"), "work", "full_outer")
    reason = F.when(F.col("depth").isNull(), RARE).when(F.col("depth") == rounds, LIMIT).otherwise(OPENED)
    rounds_log = log[0] if log else spark.createDataFrame([], "round int, opened long, cited long, found long")
    for row in log[1:]:
        rounds_log = rounds_log.unionByName(row)
    return both.select("work", "depth", F.coalesce("n", F.lit(0)).alias("n_citing"), reason.alias("reason")), rounds_log
