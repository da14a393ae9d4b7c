"""Tail probabilities, failures by arm, several baselines, and the verdict after each seed: against plain arithmetic."""

import math
import random
from statistics import NormalDist, mean, stdev

import pytest
from pyspark.sql import functions as F

from assayer.functions import student_t, tails
from assayer.operators import baselines as B
from assayer.operators import experiments as E
from assayer.operators import failures as X
from assayer.operators import sequence as S


def close(a, b, tolerance=1e-9):
    return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= tolerance


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.3, 12.0, 100.5, 4e3, 1e6, 1e9]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", tails.log_gamma(F.col("x")).alias("y")).collect()
    assert all(close(r["y"], math.lgamma(r["x"]), 1e-13 * max(1, abs(math.lgamma(r["x"])))) for r in got)


def chi_tail(x, df):
    """By the finite sums of whole degrees of freedom."""
    h = x / 2
    if df % 2 == 0:
        return sum(math.exp(-h + k * math.log(h) - math.lgamma(k + 1)) for k in range(df // 2)) if h else 1.0
    return math.erfc(math.sqrt(h)) + sum(math.exp(-h + (k - 0.5) * math.log(h) - math.lgamma(k + 0.5)) for k in range(1, df // 2 + 1)) if h else 1.0


def test_chi_square_tail(spark):
    cases = [(x, df) for df in (1, 2, 3, 4, 9, 30, 101, 2000) for x in (0.0, 1e-6, 0.3, 1.0, 3.84, df * 0.7, float(df), df * 1.01, df + 4 * math.sqrt(2 * df), 80.0)]
    got = spark.createDataFrame(cases, "x double, df int").select("x", "df", tails.chi_square_tail(F.col("x"), F.col("df")).alias("p")).collect()
    assert [(r["x"], r["df"]) for r in got if not close(r["p"], chi_tail(r["x"], r["df"]))] == []
    assert math.isnan(spark.range(1).select(tails.chi_square_tail(F.lit(1.0), F.lit(0)).alias("p")).first()["p"])


def test_student_by_beta_equals_the_series(spark):
    cases = [(t, df) for df in (1, 2, 3, 8, 40, 199, 1200) for t in (0.0, 1e-3, 0.4, -1.0, 1.96, 2.5, 6.0, 40.0)] + [(float("nan"), 3)]
    rows = spark.createDataFrame(cases, "t double, df int").select(tails.student_two_sided(F.col("t"), F.col("df")).alias("a"), student_t.two_sided_p(F.col("t"), F.col("df")).alias("b")).collect()
    assert all(close(r["a"], r["b"], 1e-10) for r in rows)


def fisher(k, row, column, n):
    weight = lambda i: math.comb(column, i) * math.comb(n - column, row - i)
    own = weight(k)
    return sum(weight(i) for i in range(max(0, row + column - n), min(row, column) + 1) if weight(i) <= own) / math.comb(n, row)


def test_small_tables_are_exact(spark):
    r = random.Random(1)
    cases = []
    for _ in range(150):
        n = r.randint(2, 60)
        row, column = r.randint(1, n - 1), r.randint(1, n - 1)
        cases.append((r.randint(max(0, row + column - n), min(row, column)), row, column, n))
    got = spark.createDataFrame(cases, "k int, r int, c int, n int").select("*", tails.exact_two_by_two(F.col("k"), F.col("r"), F.col("c"), F.col("n")).alias("p")).collect()
    assert all(close(x["p"], fisher(*x[:4]), 1e-10) for x in got)


def outcomes(spark, **groups):
    rows = [(g, arm, k < failed) for g, arms in groups.items() for arm, (n, failed) in arms.items() for k in range(n)]
    return spark.createDataFrame([(*x, "clash") for x in rows], "g string, arm string, failed boolean, statistic string")


def test_failures_by_arm(spark):
    rows = outcomes(spark, many={"a": (40, 10), "b": (50, 25), "c": (60, 12)}, small={"a": (8, 0), "b": (8, 4)}, two={"a": (80, 20), "b": (70, 30)}, none={"a": (9, 0), "b": (9, 0)}, all={"a": (3, 3), "b": (2, 2)}, one={"a": (9, 3)})
    got = {r["g"]: r for r in X.failures_by_arm(rows, ["g"]).collect()}

    def chi(*arms):
        n, f = sum(a for a, _ in arms), sum(b for _, b in arms)
        return sum((o - e) ** 2 / e for a, b in arms for o, e in ((b, a * f / n), (a - b, a * (n - f) / n)))

    stat = chi((40, 10), (50, 25), (60, 12))
    assert got["many"]["method"] == "chi-square" and close(got["many"]["statistic"], stat) and close(got["many"]["p_value"], chi_tail(stat, 2)) and got["many"]["worst_arm"] == "b"
    assert got["small"]["method"] == "exact" and close(got["small"]["p_value"], fisher(0, 8, 4, 16)) and (got["small"]["n"], got["small"]["failed"], got["small"]["arms"]) == (16, 4, 2)
    assert got["two"]["method"] == "chi-square" and close(got["two"]["p_value"], chi_tail(chi((80, 20), (70, 30)), 1))
    assert {g: (got[g]["method"], got[g]["p_value"], got[g]["worst_arm"]) for g in ("none", "all", "one")} == {"none": ("none", 1.0, None), "all": ("none", 1.0, "a"), "one": ("none", 1.0, "a")}
    assert X.failures_by_arm(rows.limit(0), ["g"]).count() == 0


def test_deliveries(spark):
    runs = spark.createDataFrame([("s", "a", "ok", {"x": 1.0, "y": 2.0}), ("s", "b", "ok", {"x": 1.0}), ("s", None, "oom", None), ("t", "a", "oom", {}), ("u", "a", None, {"x": 1.0})], "spec string, arm string, status string, metrics map<string,double>")
    got = sorted((r["spec"], r["metric"], r["arm"] or "", r["failed"]) for r in X.deliveries(runs, ["spec"]).collect())
    assert got == [("s", "x", "", True), ("s", "x", "a", False), ("s", "x", "b", False), ("s", "y", "", True), ("s", "y", "a", False), ("s", "y", "b", True), ("u", "x", "a", True)]


def holm(ps):
    order, out, most = sorted(range(len(ps)), key=ps.__getitem__), [0.0] * len(ps), 0.0
    for k, i in enumerate(order):
        most = max(most, min(1.0, (len(ps) - k) * ps[i]))
        out[i] = most
    return out


def test_step_down(spark):
    families = {"a": [0.01, 0.04, 0.03, 0.005], "b": [0.02, 0.02, 0.02], "c": [0.9, 0.8], "d": [0.001]}
    rows = [(f, str(i), p) for f, ps in families.items() for i, p in enumerate(ps)] + [("a", "x", float("nan")), ("e", "x", float("nan"))]
    got = {(r["f"], r["i"]): r["p_adjusted"] for r in B.step_down(spark.createDataFrame(rows, "f string, i string, p_value double"), ["f"]).collect()}
    for f, ps in families.items():
        assert [got[f, str(i)] for i in range(len(ps))] == [round(x, 6) for x in holm(ps)]
    assert math.isnan(got["a", "x"]) and math.isnan(got["e", "x"])


def table(spark, arms):
    return spark.createDataFrame([(k, arm, seed, "ok", {"m": v}) for k, (arm, values) in enumerate(arms.items()) for seed, v in values.items()], "ord long, arm string, seed long, status string, metrics map<string,double>")


def test_the_worst_baseline_decides(spark):
    r = random.Random(3)
    noise = [r.gauss(0, 0.01) for _ in range(8)]
    arms = {"plain": {i: 0.5 for i in range(8)}, "tuned": {i: 0.58 + noise[i] for i in range(8)}, "new": {i: 0.6 + noise[(i * 3) % 8] for i in range(8)}, "lone": {3: 0.9}}
    found = B.against_baselines(table(spark, arms), "m", ["plain", "tuned"], arms=F.col("arm").isin("new", "lone"))
    rows = {(x["arm"], x["baseline"]): x for x in found.collect()}
    assert set(rows) == {("new", "plain"), ("new", "tuned"), ("lone", "plain"), ("lone", "tuned")}
    for b in ("plain", "tuned"):
        d = [arms["new"][i] - arms[b][i] for i in range(8)]
        assert close(rows["new", b]["mean_difference"], round(mean(d), 6)) and close(rows["new", b]["sd_difference"], round(stdev(d), 6), 1e-6)
    assert [rows["new", b]["p_adjusted"] for b in ("plain", "tuned")] == pytest.approx(holm([rows["new", b]["p_value"] for b in ("plain", "tuned")]), abs=2e-6)
    rule = spark.createDataFrame([(">", 0.01, 3, 0.05), ("<", 0.5, 3, 0.05)], "comparator string, threshold double, min_seeds long, max_p_value double")
    got = {(x["comparator"], x["arm"]): (x["baseline"], x["verdict"]) for x in B.decide_against(found, rule, direction_aware=True).collect()}
    assert got[">", "new"][0] == "tuned" and got["<", "new"] == ("plain", "supported")
    assert got[">", "new"][1] == ("supported" if rows["new", "tuned"]["mean_difference"] > 0.01 and rows["new", "tuned"]["p_adjusted"] < 0.05 else "inconclusive")
    assert got[">", "lone"] == ("tuned", "inconclusive")  # one pair
    # all arms against all others, both ways
    assert B.pairs_with(table(spark, arms), "m").groupBy("arm", "baseline").count().count() == 12


def test_verdict_after_each_seed(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    r = random.Random(5)
    base = {i * 2 - 9: r.gauss(1e6, 3) for i in range(30)}
    arms = {"base": base, "up": {s: v + r.gauss(1, 2) for s, v in base.items()}, "flat": {s: v + 0.5 for s, v in base.items() if s > 0}, "one": {3: 0.0}, "down": {s: v - 1 + r.gauss(0, 1) * (s > 20) for s, v in base.items()}}
    runs = table(spark, arms)
    rule = {"comparator": ">", "threshold": 0.2, "min_seeds": 3, "max_p_value": 0.05}
    got = S.verdict_by_seed(runs, "m", "base", rule).orderBy("arm", "seed").collect()
    assert len(got) == 30 + sum(s > 0 for s in base) + 1 + 30
    rules = spark.createDataFrame([(">", 0.2, 3, 0.05)], "comparator string, threshold double, min_seeds long, max_p_value double")
    before = {}
    for x in got:
        cut = runs.where(F.col("seed") <= x["seed"]).where(F.col("arm").isin("base", x["arm"]))
        if x["seed"] % 9 == 0 or x["arm"] == "one":  # against the comparison of the runs so far
            one = E.comparisons(cut, "m", "base", seeds=False)
            y = E.decide(one, rules).first()
            assert (x["n_pairs"], x["verdict"]) == (y["n_pairs"], y["verdict"])
            assert all(close(x[c], y[c], 3e-6) for c in ("mean_difference", "ci_low", "ci_high", "p_value"))
        assert x["changed"] == (x["arm"] in before and before[x["arm"]] != x["verdict"])
        before[x["arm"]] = x["verdict"]
    for s in S.settled(S.verdict_by_seed(runs, "m", "base", rule)).collect():
        own = [(x["n_pairs"], x["seed"], x["verdict"]) for x in got if x["arm"] == s["arm"]]
        k = next(i for i in range(len(own)) if len({v for *_, v in own[i:]}) == 1)
        supported = [n for n, _, v in own if v == "supported"]
        assert (s["n_pairs"], s["verdict"], s["holds_from"], s["holds_from_seed"], s["first_supported"]) == (own[-1][0], own[-1][2], own[k][0], own[k][1], min(supported, default=None))
        assert s["changes"] == sum(a[2] != b[2] for a, b in zip(own, own[1:], strict=False)) and s["flipped"] == ({"supported", "refuted"} <= {v for *_, v in own})


def test_tails_of_many_degrees_of_freedom_take_bounded_steps(spark):
    normal = NormalDist()
    cases = [(t / 8, n) for t in range(1, 45) for n in (10**5, 10**6)]
    half, b = F.lit(0.5), F.col("df") / 2
    rows = spark.createDataFrame(cases, "t double, df long").select("t", "df", tails.student_two_sided(F.col("t"), F.col("df")).alias("p"), F.greatest(tails.beta_steps(half, b), tails.beta_steps(b, half)).alias("steps")).collect()
    for r in rows:
        # two terms of the expansion about the normal tail
        t, n = r["t"], r["df"]
        near = 2 * (1 - normal.cdf(t)) + 2 * normal.pdf(t) * (t**3 + t) / (4 * n)
        assert abs(r["p"] - near) < 1e-8 and r["steps"] <= 60
