"""All arms against several baselines in one pass, corrected for the number of comparisons; the worst baseline decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import experiments as E


def pairs_with(runs: DataFrame, metric: str, baselines: Sequence[str] | None = None) -> DataFrame:
    """arm, baseline, seed and difference of every arm to every baseline's run of the same seed; no arm is paired with itself.

    ``baselines``: all arms if left out. Runs are reduced to one of each arm and seed once, for both sides.
    """
    own = E.last_of_each_seed(runs, metric)
    base = own.select(F.col("arm").alias("baseline"), "seed", F.col("value").alias("base"))
    if baselines is not None:
        base = base.where(F.col("baseline").isin(*baselines))
    return own.join(base, "seed").where("arm <> baseline").select("arm", "baseline", "seed", (F.col("value") - F.col("base")).alias("difference"))


def step_down(found: DataFrame, family: Sequence[str], p: str = "p_value", adjusted: str = "p_adjusted") -> DataFrame:
    """Adds Holm's adjusted p to comparisons of a family (rows of equal ``family`` columns).

    Of m tests the k-th smallest p counts m - k + 1 times, 1 at most, and no less than those before it; so equal p have
    equal adjusted values. A NaN (one pair) is no test: it stays NaN and does not count in m.
    """
    real = ~F.isnan(p)
    by_p = Window.partitionBy(*family, real).orderBy(p)
    times = F.count("*").over(Window.partitionBy(*family, real)) - F.row_number().over(by_p) + 1
    rows = found.withColumn("_q", F.least(F.lit(1.0), times * F.col(p)))
    run = F.max("_q").over(by_p.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(adjusted, F.when(real, E.rounded(run)).otherwise(E.NAN)).drop("_q")


def against_baselines(runs: DataFrame, metric: str, baselines: Sequence[str] | None = None, confidence: float = E.CONFIDENCE, arms: Column | None = None) -> DataFrame:
    """Comparisons of each arm with each baseline, with the adjusted p of the arm's family.

    ``arms``: a condition on ``arm``; without it baselines are compared with each other, too.
    """
    differences = pairs_with(runs, metric, baselines)
    return step_down(E.compared(differences if arms is None else differences.where(arms), confidence), ["arm"])


def decide_against(found: DataFrame, rule: DataFrame, direction_aware: bool = False) -> DataFrame:
    """One verdict for each rule and arm, on the baseline that the arm does worst against, with its adjusted p.

    The worst has the least mean difference (of equal ones the first by name); with ``direction_aware``, for rules that want
    small values, the largest. An arm without a comparison has no row. The result's frame is rules x arms: two short lists.
    """
    columns = [c for c in found.columns if c not in ("arm", "p_value", "p_adjusted")] + ["p_value"]
    rows = found.withColumn("p_value", F.col("p_adjusted"))
    worst = lambda key: F.min_by(F.struct(*columns), F.struct(key, "baseline"))
    least = F.col("mean_difference")
    picked = rows.groupBy("arm").agg(worst(least).alias("_low"), worst(-least).alias("_high"))
    small = F.col("comparator").isin("<", "<=") & F.lit(direction_aware)
    joined = rule.crossJoin(picked).withColumn("_c", F.when(small, F.col("_high")).otherwise(F.col("_low"))).select(*rule.columns, "arm", "_c.*")
    return E.judged(joined, [*rule.columns, "baseline"])
