"""The verdict after each seed: running comparisons in the order of seeds, and where the verdict settles.

Seeds of an arm are cut into blocks of ``BLOCK`` numbers, so a window holds at most ``BLOCK`` rows however many seeds
an arm has; what comes before a block is the running sum of the block totals. Sums are of differences less the arm's
mean, so that squares of large values do not cancel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from assayer.functions import student_t, tails
from assayer.functions.text import once
from assayer.operators import experiments as E
from assayer.operators.skew import look_up

BLOCK = 4096


def running(differences: DataFrame) -> DataFrame:
    """arm, block, seed, shift, n, s1 and s2 of the differences up to each seed: count, sum and sum of squares of the differences less ``shift``,
    the arm's mean. Every block but an arm's first begins with a row without seed, which has the sums of all blocks before it.
    One row an arm and seed is expected."""
    shift = differences.groupBy("arm").agg(F.avg("difference").alias("shift"))
    rows = look_up(differences, shift, ["arm"]).select("arm", F.floor(F.col("seed") / BLOCK).alias("block"), "seed", "shift", F.lit(1).cast("long").alias("one"), (F.col("difference") - F.col("shift")).alias("d"))
    rows = rows.withColumn("q", F.col("d") * F.col("d"))
    before = Window.partitionBy("arm").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("arm", "block", "shift").agg(*(F.sum(c).alias(c) for c in ("one", "d", "q")))
    carried = totals.select("arm", "block", F.lit(None).cast("long").alias("seed"), "shift", *(F.sum(c).over(before).alias(c) for c in ("one", "d", "q"))).where("one IS NOT NULL")
    up_to = _inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.unionByName(carried).select("arm", "block", "seed", "shift", F.sum("one").over(up_to).alias("n"), F.sum("d").over(up_to).alias("s1"), F.sum("q").over(up_to).alias("s2"))


def _inside() -> WindowSpec:
    return Window.partitionBy("arm", "block").orderBy(F.asc_nulls_first("seed"))


def _critical_values(rows: DataFrame, confidence: float) -> DataFrame:
    """The critical values of fewer than ``MANY`` degrees of freedom: so many rows."""
    few = rows.sparkSession.range(1, student_t.MANY).select(F.col("id").alias("df"))
    return few.select(F.col("df"), student_t.critical(F.col("df"), confidence).alias("t"))


def _figures(rows: DataFrame, confidence: float) -> DataFrame:
    """arm, block and seed with n_pairs, mean_difference, sd_difference, ci_low, ci_high and p_value."""
    n = F.col("n")
    mean = F.col("shift") + F.col("s1") / n
    sd = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / n) / F.greatest(n - 1, F.lit(1))))).otherwise(0.0)
    # values that are equal leave rounding errors of the shift
    sd = F.when(sd > 1e-12 * (F.abs(mean) + F.abs(F.col("shift"))), sd).otherwise(0.0)
    rows = once(rows, "arm", "block", "seed", "n", mean.alias("m"), sd.alias("sd"), (sd / F.sqrt(n)).alias("error"))
    rows = rows.join(F.broadcast(_critical_values(rows, confidence)), n - 1 == F.col("df"), "left")
    t = F.coalesce("t", student_t.critical_of_many(F.greatest(n - 1, F.lit(1)), confidence))
    one, flat = n == 1, F.col("error") == 0
    p = F.when(one, E.NAN).when(flat, F.when(F.col("m") != 0, 0.0).otherwise(1.0)).otherwise(tails.student_two_sided(F.col("m") / F.when(flat, 1.0).otherwise(F.col("error")), F.greatest(n - 1, F.lit(1))))
    bound = lambda sign: F.when(one, E.NAN).when(flat, F.col("m")).otherwise(F.col("m") + sign * t * F.col("error"))
    figures = {"mean_difference": F.col("m"), "sd_difference": F.col("sd"), "ci_low": bound(-1), "ci_high": bound(1), "p_value": p}
    return once(rows.withColumn("n_pairs", n), "arm", "block", "seed", "n_pairs", *(E.rounded(v).alias(k) for k, v in figures.items()))


def verdict_by_seed(runs: DataFrame, metric: str, baseline: str, rule: dict, confidence: float = E.CONFIDENCE) -> DataFrame:
    """A row for each arm and seed, in the order of seeds: the comparison of all seeds so far, its verdict by ``rule``
    (comparator, threshold, min_seeds, max_p_value), and ``changed``, whether the seed before it had another one.

    The first seed changes nothing. A null seed is left out, as it has no place in the order.
    """
    rows = _figures(running(E.pairs(runs, metric, baseline).where("seed IS NOT NULL")), confidence)
    rule_columns = {k: F.lit(rule[k]).cast(kind) for k, kind in (("comparator", "string"), ("threshold", "double"), ("min_seeds", "long"), ("max_p_value", "double"))}
    rows = E.judged(rows.withColumns(rule_columns), ["block", "seed", "sd_difference"])
    before = F.lag("verdict").over(_inside())
    rows = rows.withColumn("changed", F.coalesce(F.col("verdict") != before, F.lit(False))).where("seed IS NOT NULL")
    return rows.select("arm", "seed", "n_pairs", "mean_difference", "sd_difference", "ci_low", "ci_high", "p_value", "verdict", "changed")


def settled(sequence: DataFrame) -> DataFrame:
    """Of each arm of ``verdict_by_seed``: its last verdict, how often it changed, the pairs and the seed from which it has
    held, the fewest pairs at which it was ever supported, and ``flipped``: whether both supported and refuted occurred."""
    last = F.max_by("verdict", "n_pairs")
    change = F.max(F.when(F.col("changed"), F.struct("n_pairs", "seed")))
    first = F.min(F.struct("n_pairs", "seed"))
    holds = F.coalesce(change, first)
    return sequence.groupBy("arm").agg(
        F.max("n_pairs").alias("n_pairs"),
        last.alias("verdict"),
        F.count_if("changed").alias("changes"),
        holds["n_pairs"].alias("holds_from"),
        holds["seed"].alias("holds_from_seed"),
        F.min(F.when(F.col("verdict") == E.SUPPORTED, F.col("n_pairs"))).alias("first_supported"),
        ((F.count_if(F.col("verdict") == E.SUPPORTED) > 0) & (F.count_if(F.col("verdict") == E.REFUTED) > 0)).alias("flipped"),
    )
