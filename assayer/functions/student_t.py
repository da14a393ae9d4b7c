"""Student's t distribution for whole degrees of freedom, by its finite series, as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

MANY = 200


def _central(theta: Column, df: Column) -> Column:
    """P(|T| <= t) with theta = atan(t / sqrt(df))."""
    s, c = F.sin(theta), F.cos(theta)
    even = df % 2 == 0
    steps = F.when(even, df.cast("long") / 2 - 1).otherwise((df - 3) / 2).cast("int")
    # terms c^k times running products of odd over even numbers (or even over odd ones)
    series = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, k: F.struct(
            (acc["term"] * c * c * F.when(even, (2 * k - 1) / (2 * k)).otherwise((2 * k) / (2 * k + 1))).alias("term"),
            (acc["sum"] + acc["term"] * c * c * F.when(even, (2 * k - 1) / (2 * k)).otherwise((2 * k) / (2 * k + 1))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    odd = F.when(df == 1, 2 * theta / math.pi).otherwise(2 / math.pi * (theta + s * c * series))
    return F.when(even, s * series).otherwise(odd)


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|); NaN if df is not positive or t is NaN."""
    nan = F.lit(float("nan"))
    whole = F.when(df > 0, df).otherwise(1)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - _central(F.atan(F.abs(t) / F.sqrt(whole.cast("double"))), whole)))
    return F.when((df <= 0) | F.isnan(t), nan).otherwise(p)


def upper_tail(t: Column, df: Column) -> Column:
    """P(T >= t) for t of either sign."""
    half = two_sided_p(t, df) / 2
    return F.when(t < 0, 1 - half).otherwise(half)


def critical(df: Column, confidence: float = 0.95) -> Column:
    """The t with P(|T| <= t) = confidence; NaN if df is not positive.

    By bisection of its angle, or, from ``MANY`` degrees of freedom on, by its expansion about the normal
    quantile, whose error there is below 1e-9.
    """
    whole = F.when(df > 0, df).otherwise(1)
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.struct(F.lit(0.0).alias("low"), F.lit(math.pi / 2).alias("high")),
        lambda acc, _: F.when(
            _central((acc["low"] + acc["high"]) / 2, whole) < confidence, F.struct(((acc["low"] + acc["high"]) / 2).alias("low"), acc["high"].alias("high"))
        ).otherwise(F.struct(acc["low"].alias("low"), ((acc["low"] + acc["high"]) / 2).alias("high"))),
        lambda acc: F.tan((acc["low"] + acc["high"]) / 2) * F.sqrt(whole.cast("double")),
    )
    return F.when(df >= MANY, critical_of_many(df, confidence)).when(df > 0, found).otherwise(float("nan"))


def critical_of_many(df: Column, confidence: float = 0.95) -> Column:
    """The same for ``MANY`` degrees of freedom or more: the expansion about the normal quantile."""
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    n = df.cast("double")
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return sum((g / F.pow(n, F.lit(k + 1)) for k, g in enumerate(terms)), F.lit(z))
