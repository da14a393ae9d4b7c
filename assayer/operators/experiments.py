"""Experiment runs: summaries per arm, differences paired by seed, and verdicts of a decision rule.

A run is a row (ord, arm, seed, status, metrics): ``metrics`` maps names to doubles and ``ord`` is the
order in its source. All functions take and return DataFrames; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import student_t
from assayer.functions.text import let

SUPPORTED, REFUTED, INCONCLUSIVE = "supported", "refuted", "inconclusive"
PLACES = 6
CONFIDENCE = 0.95
NAN = float("nan")


def measured(runs: DataFrame, metric: str) -> DataFrame:
    """Successful runs that have the metric: ord, arm, seed, value."""
    return runs.where((F.col("status") == "ok") & F.map_contains_key("metrics", F.lit(metric))).select("ord", "arm", "seed", F.col("metrics")[metric].alias("value"))


def arm_summary(runs: DataFrame, metric: str) -> DataFrame:
    """n, mean, sample deviation (0 for one run) and ascending values of each arm; repeated seeds all count."""
    return measured(runs, metric).groupBy("arm").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.sort_array(F.collect_list("value")).alias("values")
    )


def arm_moments(runs: DataFrame, metric: str) -> DataFrame:
    """As ``arm_summary`` without the list of values, for arms of any size."""
    return measured(runs, metric).groupBy("arm").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))


def arm_values(runs: DataFrame, metric: str) -> DataFrame:
    """The values of each arm as rows (arm, value) in ascending order, for arms of any size."""
    return measured(runs, metric).select("arm", "value").orderBy("arm", "value")


def last_of_each_seed(runs: DataFrame, metric: str) -> DataFrame:
    """One value for each arm and seed: of repeated ones the last."""
    return measured(runs, metric).groupBy("arm", "seed").agg(F.max_by("value", "ord").alias("value"))


def pairs(runs: DataFrame, metric: str, baseline: str) -> DataFrame:
    """arm, seed and difference to the baseline's run of the same seed."""
    own = last_of_each_seed(runs, metric)
    base = own.where(F.col("arm") == baseline).select("seed", F.col("value").alias("base"))
    return own.where(F.col("arm") != baseline).join(base, "seed").select("arm", "seed", (F.col("value") - F.col("base")).alias("difference"))


def rounded(c: Column) -> Column:
    return let(c, lambda x: F.when(F.isnan(x), F.lit(NAN)).otherwise(F.bround(x, PLACES)))


def comparisons(runs: DataFrame, metric: str, baseline: str, confidence: float = CONFIDENCE, seeds: bool = True) -> DataFrame:
    """Paired comparison of each arm with the baseline: n_pairs, mean and deviation of the differences,
    confidence interval, two-sided p, and the seeds (``seeds``: whether they are listed).

    One pair: deviation 0, the rest NaN. No spread: the interval is a point, p is 0, or 1 for no difference.
    """
    return compared(pairs(runs, metric, baseline).withColumn("baseline", F.lit(baseline)), confidence, seeds)


def compared(differences: DataFrame, confidence: float = CONFIDENCE, seeds: bool = False) -> DataFrame:
    """The same of differences (arm, baseline, seed, difference), for each arm and baseline."""
    lists = [F.sort_array(F.collect_list("seed")).alias("seeds")] if seeds else []
    d = differences.groupBy("arm", "baseline").agg(F.count("*").alias("n_pairs"), F.avg("difference").alias("m"), F.coalesce(F.stddev_samp("difference"), F.lit(0.0)).alias("sd"), *lists)
    error = F.col("sd") / F.sqrt("n_pairs")
    one, flat = F.col("n_pairs") == 1, error == 0
    d = d.withColumn("half", student_t.critical(F.col("n_pairs") - 1, confidence) * error)
    p = F.when(one, NAN).when(flat, F.when(F.col("m") != 0, 0.0).otherwise(1.0)).otherwise(student_t.two_sided_p(F.col("m") / F.when(flat, 1.0).otherwise(error), F.col("n_pairs") - 1))
    bound = lambda sign: F.when(one, NAN).when(flat, F.col("m")).otherwise(F.col("m") + sign * F.col("half"))
    return d.select(
        "arm",
        "baseline",
        "n_pairs",
        rounded(F.col("m")).alias("mean_difference"),
        rounded(F.col("sd")).alias("sd_difference"),
        rounded(bound(-1)).alias("ci_low"),
        rounded(bound(1)).alias("ci_high"),
        rounded(p).alias("p_value"),
        *(["seeds"] if seeds else []),
    )


def failures(runs: DataFrame) -> DataFrame:
    """Number of runs of each status but ok."""
    return runs.where("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n"))


def totals(runs: DataFrame) -> DataFrame:
    """runs_total and runs_ok, whether or not a run has the metric."""
    return runs.agg(F.count("*").alias("runs_total"), F.count_if(F.col("status") == "ok").alias("runs_ok"))


def metric_names(runs: DataFrame) -> DataFrame:
    """Names of metrics over all runs, failed ones included."""
    return runs.select(F.explode(F.map_keys("metrics")).alias("metric")).distinct()


def inferred_baseline(runs: DataFrame, metric: str) -> DataFrame:
    """The arm of least mean; of equal ones the first by name."""
    return arm_moments(runs, metric).agg(F.min_by("arm", F.struct("mean", "arm")).alias("baseline")).where("baseline IS NOT NULL")


def report(runs: DataFrame, metric: str | None = None, baseline: str | None = None, confidence: float = CONFIDENCE) -> dict:
    """The parts of a report as DataFrames: metric, baseline, confidence, arms, comparisons, totals, failures; arms, comparisons
    and failures in the order of their names.

    Without a metric the only one is taken, without a baseline the arm of least mean. Raises ValueError
    for no run, and if the metric is not given and the runs have none or several.
    """
    if runs.isEmpty():
        raise ValueError("no runs")
    if metric is None:
        names = [r[0] for r in metric_names(runs).orderBy("metric").limit(21).collect()]
        if len(names) != 1:
            raise ValueError(f"name a metric: the runs have {', '.join(names) or 'none'}")
        metric = names[0]
    if baseline is None:
        found = inferred_baseline(runs, metric).first()
        baseline = found["baseline"] if found else ""
    arms = arm_summary(runs, metric).select("arm", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("sd")).alias("sd"), F.transform("values", rounded).alias("values"))
    return {"metric": metric, "baseline": baseline, "confidence": confidence, "arms": arms.orderBy("arm"), "comparisons": comparisons(runs, metric, baseline, confidence).orderBy("arm"), "totals": totals(runs), "failures": failures(runs).orderBy("status")}


def passes(comparator: Column, value: Column, threshold: Column) -> Column:
    """value comparator threshold; an unknown comparator counts as >. False for NaN."""
    return ~F.isnan(value) & F.when(comparator == ">=", value >= threshold).when(comparator == "<", value < threshold).when(comparator == "<=", value <= threshold).otherwise(value > threshold)


def worst_comparison(found: DataFrame, arm: str | None = None, comparator: str | None = None) -> DataFrame:
    """The comparison of least mean difference (of equal ones the first by arm), of all arms or one.

    With a ``comparator`` that wants small values, the one of largest difference: the least favourable.
    """
    if arm is not None:
        found = found.where(F.col("arm") == arm)
    key = -F.col("mean_difference") if comparator in ("<", "<=") else F.col("mean_difference")
    return found.agg(F.min_by(F.struct(*found.columns), F.struct(key, "arm")).alias("c")).where("c IS NOT NULL").select("c.*")


def decide(found: DataFrame, rule: DataFrame, arm: str | None = None, direction_aware: bool = False) -> DataFrame:
    """One verdict for each rule (metric, comparator, threshold, min_seeds, max_p_value), on the worst comparison.

    In this order: no comparison, or fewer pairs than the rule asks for: inconclusive; effect and
    significance pass: supported; the whole interval on the wrong side: refuted; else inconclusive.
    """
    worst = worst_comparison(found, arm)
    if direction_aware:
        other = worst_comparison(found, arm, "<")
        small = F.col("comparator").isin("<", "<=")
        sides = [(rule.where(~small), worst), (rule.where(small), other)]
    else:
        sides = [(rule, worst)]
    joined = [r.join(F.broadcast(w), F.lit(True), "left") for r, w in sides]  # one row on the right
    rows = joined[0]
    for more in joined[1:]:
        rows = rows.unionByName(more)
    return judged(rows, rule.columns)


def judged(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of rows that hold a rule and a comparison, with the comparison's figures, checks, verdict and reason."""
    none = F.col("n_pairs").isNull()
    few = F.col("n_pairs") < F.col("min_seeds")
    effect = F.coalesce(passes(F.col("comparator"), F.col("mean_difference"), F.col("threshold")), F.lit(False))
    significant = F.coalesce(~F.isnan("p_value") & (F.col("p_value") < F.col("max_p_value")), F.lit(False))
    out = F.when(F.col("comparator").isin(">", ">="), ~F.isnan("ci_high") & (F.col("ci_high") < F.col("threshold"))).otherwise(~F.isnan("ci_low") & (F.col("ci_low") > F.col("threshold")))
    verdict = F.when(none | few, INCONCLUSIVE).when(effect & significant, SUPPORTED).when(out, REFUTED).otherwise(INCONCLUSIVE)
    reason = (
        F.when(none, "no comparison")
        .when(few, F.format_string("%d of %d pairs", "n_pairs", "min_seeds"))
        .when(effect & significant, F.format_string("difference %+.4f, p %.4f over %d pairs", "mean_difference", "p_value", "n_pairs"))
        .when(out, F.format_string("interval [%+.4f, %+.4f] rules %+.4f out", "ci_low", "ci_high", "threshold"))
        .otherwise(F.concat(F.lit("not passed: "), F.array_join(F.filter(F.array(F.when(~effect, "effect"), F.when(~significant, "significance")), lambda x: x.isNotNull()), ", ")))
    )
    return rows.select(
        *columns,
        "arm",
        "n_pairs",
        "mean_difference",
        "ci_low",
        "ci_high",
        "p_value",
        (~none & ~few).alias("seeds_pass"),
        effect.alias("effect_pass"),
        significant.alias("significance_pass"),
        (verdict == REFUTED).alias("equivalence_pass"),
        verdict.alias("verdict"),
        reason.alias("reason"),
    )


def downgrade(verdicts: DataFrame, blocked: Column) -> DataFrame:
    """A blocking critique makes any verdict inconclusive and marks it."""
    hit = F.coalesce(blocked, F.lit(False)) & (F.col("verdict") != INCONCLUSIVE)
    return verdicts.withColumn("downgraded_by_critique", hit).withColumn("verdict", F.when(hit, INCONCLUSIVE).otherwise(F.col("verdict")))
