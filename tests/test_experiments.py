import math
from statistics import mean, stdev

import pytest

from assayer.functions import student_t
from assayer.operators import experiments as E
from pyspark.sql import functions as F

FIELDS = "metric string, comparator string, threshold double, min_seeds long, max_p_value double"


def runs(spark, **arms):
    """Runs with metric ``gap``: the seeds of an arm are 3, 4, and so on."""
    rows = [(k, arm, 3 + i, "ok", {"gap": v}) for k, (arm, values) in enumerate(arms.items()) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ord long, arm string, seed long, status string, metrics map<string,double>")


def verdict(spark, rule, **arms):
    return E.decide(E.comparisons(runs(spark, **arms), "gap", "plain"), spark.createDataFrame([("gap", *rule)], FIELDS)).first()


PLAIN = [4.0, 4.4, 3.8, 4.6]


def plus(*extra):
    return [round(a + b, 6) for a, b in zip(PLAIN, extra, strict=False)]


@pytest.mark.parametrize(
    "coated, expected",
    [
        (plus(1.0, 1.1, 0.9, 1.0), "supported"),
        (plus(1.0, -1.4, 2.2, -0.6), "inconclusive"),
        (plus(0.02, 0.03, 0.01, 0.02), "refuted"),
        (plus(0.2, 0.2, 0.2, 0.2), "refuted"),
        (plus(9.0), "inconclusive"),
        (plus(0.01, 0.01), "inconclusive"),
    ],
)
def test_scenarios(spark, coated, expected):
    assert verdict(spark, (">", 0.5, 3, 0.05), plain=PLAIN[: len(coated)], coated=coated)["verdict"] == expected


def test_the_worst_arm_decides_but_for_a_named_one(spark):
    r = runs(spark, plain=PLAIN, coated=plus(1.0, 1.1, 0.9, 1.0), ribbed=plus(0.7, 0.8, 0.6, 0.7))
    rule = spark.createDataFrame([("gap", ">", 0.9, 3, 0.05)], FIELDS)
    found = E.comparisons(r, "gap", "plain")
    row = E.decide(found, rule).first()
    assert row["arm"] == "ribbed" and row["mean_difference"] == 0.7 and row["verdict"] == "refuted"
    assert E.decide(found, rule, arm="coated").first()["verdict"] == "supported"
    small = spark.createDataFrame([("gap", "<", 0.9, 3, 0.05)], FIELDS)
    assert E.decide(found, small).first()["arm"] == "ribbed" and E.decide(found, small, direction_aware=True).first()["arm"] == "coated"


@pytest.mark.parametrize("comparator, threshold, expected", [(">=", 1.0, "supported"), (">", 1.0, "inconclusive"), ("<", 1.2, "supported"), ("<=", 0.5, "refuted"), ("=>", 0.5, "supported"), ("=>", 1.5, "inconclusive")])
def test_comparators(spark, comparator, threshold, expected):
    assert verdict(spark, (comparator, threshold, 4, 0.05), plain=PLAIN, coated=plus(1.0, 1.1, 0.9, 1.0))["verdict"] == expected


def test_comparison_matches_plain_arithmetic(spark):
    base, other = [1.2, 0.7, 2.9], [1.9, 0.4, 3.3]
    d = [b - a for a, b in zip(base, other, strict=True)]
    error = stdev(d) / math.sqrt(3)
    t = abs(mean(d) / error)
    half = 0.95 * math.sqrt(2 / (1 - 0.95**2)) * error  # two degrees of freedom have closed forms
    row = E.comparisons(runs(spark, plain=base, coated=other), "gap", "plain").first()
    expected = (mean(d), stdev(d), mean(d) - half, mean(d) + half, 1 - t / math.sqrt(2 + t * t))
    got = [row[k] for k in ("mean_difference", "sd_difference", "ci_low", "ci_high", "p_value")]
    assert all(abs(a - b) <= 6e-7 for a, b in zip(got, expected, strict=True)) and row["seeds"] == [3, 4, 5]


def test_pairs_without_spread_and_single_pairs(spark):
    row = E.comparisons(runs(spark, plain=[2.5], coated=[7.5]), "gap", "plain").first()
    assert row["n_pairs"] == 1 and math.isnan(row["p_value"]) and math.isnan(row["ci_low"]) and row["sd_difference"] == 0
    flat = {r["arm"]: (r["ci_low"], r["ci_high"], r["p_value"]) for r in E.comparisons(runs(spark, plain=[1.0, 2.0], moved=[1.5, 2.5], still=[1.0, 2.0]), "gap", "plain").collect()}
    assert flat == {"moved": (0.5, 0.5, 0.0), "still": (0.0, 0.0, 1.0)}


def test_unequal_seeds_pair_where_they_meet(spark):
    row = E.comparisons(runs(spark, plain=PLAIN[:2], coated=plus(1.0, 1.1, 0.9, 1.0)), "gap", "plain").first()
    assert row["n_pairs"] == 2 and row["seeds"] == [3, 4]


def test_unknown_baseline_gives_no_comparison(spark):
    found = E.comparisons(runs(spark, coated=PLAIN, ribbed=PLAIN), "gap", "plain")
    assert found.count() == 0
    row = E.decide(found, spark.createDataFrame([("gap", ">", 0.0, 1, 0.5)], FIELDS)).first()
    assert row["verdict"] == "inconclusive" and row["reason"] == "no comparison"


def test_repeated_seed_counts_in_the_summary_and_pairs_last(spark):
    rows = [(0, "plain", 9, "ok", {"gap": 2.0}), (1, "coated", 9, "ok", {"gap": 5.0}), (2, "coated", 9, "ok", {"gap": 3.5}), (3, "coated", 8, "burst", {})]
    r = spark.createDataFrame(rows, "ord long, arm string, seed long, status string, metrics map<string,double>")
    assert {x["arm"]: (x["n"], x["values"]) for x in E.arm_summary(r, "gap").collect()} == {"plain": (1, [2.0]), "coated": (2, [3.5, 5.0])}
    assert [tuple(x) for x in E.arm_values(r, "gap").collect()] == [("coated", 3.5), ("coated", 5.0), ("plain", 2.0)]
    assert E.pairs(r, "gap", "plain").first()["difference"] == 1.5
    report = E.report(r)
    assert report["baseline"] == "plain" and report["failures"].collect() == [("burst", 1)] and report["totals"].first() == (4, 3)


def test_report_needs_runs_and_one_metric(spark):
    two = spark.createDataFrame([(0, "a", 1, "ok", {"gap": 1.0, "cost": 2.0})], "ord long, arm string, seed long, status string, metrics map<string,double>")
    for r in (two, two.limit(0)):
        with pytest.raises(ValueError):
            E.report(r)


def test_student_t_has_closed_forms(spark):
    """One degree of freedom: the tail is an arc tangent; two: a square root."""
    df = spark.createDataFrame([(0.3,), (1.0,), (2.5,), (40.0,)], "t double")
    for r in df.select("t", student_t.two_sided_p(F.col("t"), F.lit(1)).alias("one"), student_t.two_sided_p(-F.col("t"), F.lit(2)).alias("two"), student_t.upper_tail(-F.col("t"), F.lit(1)).alias("tail")).collect():
        assert abs(r["one"] - (1 - 2 * math.atan(r["t"]) / math.pi)) < 1e-12 and abs(r["two"] - (1 - r["t"] / math.sqrt(2 + r["t"] ** 2))) < 1e-12
        assert abs(r["tail"] - (1 - r["one"] / 2)) < 1e-12
    none = spark.range(1).select(student_t.two_sided_p(F.lit(1.0), F.lit(0)), student_t.critical(F.lit(0))).first()
    assert all(map(math.isnan, none))


def test_critical_values_undo_tails(spark):
    df = spark.createDataFrame([(k,) for k in (1, 2, 5, 17, 60, 199, 200, 201, 1000, 5001)], "df long").withColumn("c", student_t.critical(F.col("df"), 0.99))
    assert all(abs(r[0] - 0.01) < 1e-8 for r in df.select(student_t.two_sided_p(F.col("c"), F.col("df"))).collect())


def test_nan_never_passes(spark):
    df = spark.createDataFrame([(float("nan"),)], "x double")
    assert df.select(*(E.passes(F.lit(c), F.col("x"), F.lit(0.0)) for c in (">", ">=", "<", "<="))).first()[:] == (False,) * 4


def test_downgrade(spark):
    v = spark.createDataFrame([("refuted", True), ("supported", None), ("inconclusive", True)], "verdict string, blocked boolean")
    got = E.downgrade(v, F.col("blocked")).collect()
    assert [(r["verdict"], r["downgraded_by_critique"]) for r in got] == [("inconclusive", True), ("supported", False), ("inconclusive", False)]
