"""Whether failures go with the arm: tests of independence for each spec and metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import tails
from assayer.operators.skew import look_up

#: Expected count of a cell below which a 2 x 2 table is summed exactly.
SMALL = 5


def deliveries(runs: DataFrame, by: list[str]) -> DataFrame:
    """Rows (*by, metric, arm, failed) of runs (*by, arm, status, metrics), one for each run and each metric that any run of
    its group has: failed without status ok, or without the metric. Groups without a metric have no row."""
    runs = runs.select(*by, "arm", "status", "metrics")
    names = runs.select(*by, F.explode(F.map_keys("metrics")).alias("metric")).distinct().groupBy(*by).agg(F.collect_list("metric").alias("_names"))  # a group's metrics are few
    rows = look_up(runs, names, by).select(*by, "arm", "status", "metrics", F.explode("_names").alias("metric"))
    return rows.select(*by, "metric", "arm", (~F.coalesce((F.col("status") == "ok") & F.map_contains_key("metrics", F.col("metric")), F.lit(False))).alias("failed"))


def failures_by_arm(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Independence of ``failed`` and ``arm`` in each group: n, failed, arms, statistic, method, p_value, worst_arm.

    Chi-square with arms - 1 degrees of freedom, or, for two arms of which a cell is expected to hold fewer than ``SMALL``,
    the exact sum; such a table has at most about the root of 5 n terms. With one arm, no failure or nothing but
    failures there is nothing to test: method ``none``, p 1. worst_arm fails most often (of equal ones the first by name);
    null without a failure. Rows with a null arm count as an arm of their own; null outcomes are failures.
    Counts are summed before they move, so arms and groups of any size take a row a task.
    """
    arms = outcomes.groupBy(*by, F.coalesce("arm", F.lit("")).alias("arm")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("failed", F.lit(True))).alias("f"))
    rows = arms.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("f").alias("failed"),
        F.count("*").alias("arms"),
        F.min("n").alias("_least"),
        F.sum(F.col("f") * (F.col("f") / F.col("n"))).alias("_q"),
        F.min_by(F.struct("n", "f"), "arm").alias("_one"),
        F.min_by("arm", F.struct(-F.col("f") / F.col("n"), "arm")).alias("_worst"),
    )
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    tested = (F.col("arms") > 1) & (F.col("failed") > 0) & (F.col("failed") < F.col("n"))
    small = (F.col("arms") == 2) & (F.col("_least") * F.least(f, n - f) / n < SMALL)
    statistic = F.greatest(F.lit(0.0), n * n / (f * (n - f)) * (F.col("_q") - f * f / n))
    rows = rows.withColumn("statistic", F.when(tested, statistic).otherwise(0.0)).withColumn("method", F.when(~tested, "none").when(small, "exact").otherwise("chi-square"))
    p = (
        F.when(F.col("method") == "exact", tails.exact_two_by_two(F.col("_one.f"), F.col("_one.n"), f, n))
        .when(F.col("method") == "chi-square", tails.chi_square_tail(F.col("statistic"), F.col("arms") - 1))
        .otherwise(1.0)
    )
    return rows.select(*by, "n", "failed", "arms", "statistic", "method", p.alias("p_value"), F.when(F.col("failed") > 0, F.col("_worst")).alias("worst_arm"))
