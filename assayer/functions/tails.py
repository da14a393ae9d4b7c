"""Tail probabilities as column expressions: log gamma, chi-square by the incomplete gamma function, and 2 x 2 tables exactly."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import let

_SHIFT = 12
#: Bernoulli terms of the expansion of log gamma (fixed values).
_STIRLING = ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188))


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0, to about 14 digits: its expansion at x + 12, carried down by the recurrence."""
    z = x + float(_SHIFT)
    product = x
    for i in range(1, _SHIFT):
        product = product * (x + float(i))
    series = sum((c / F.pow(z, F.lit(float(k))) for k, c in _STIRLING), F.lit(0.0))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def _lower_series(a: Column, x: Column, steps: Column) -> Column:
    """P(a, x) by its power series, for x < a + 1."""
    pair = lambda term, total: F.struct(term.alias("term"), total.alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), steps), pair(1 / a, 1 / a), lambda acc, n: let(acc["term"] * x / (a + n), lambda t: pair(t, acc["total"] + t)), lambda acc: acc["total"])
    return total * F.exp(-x + a * F.ln(x) - log_gamma(a))


def _upper_fraction(a: Column, x: Column, steps: Column) -> Column:
    """Q(a, x) by its continued fraction, evaluated from the last step up, for x >= a + 1."""
    tail = F.aggregate(F.sequence(F.lit(0), steps - 1), F.lit(0.0), lambda acc, i: let((steps - i).cast("double"), lambda k: k * (a - k) / (x + 2 * k + 1 - a + acc)))
    return F.exp(-x + a * F.ln(x) - log_gamma(a)) / (x + 1 - a + tail)


def upper_gamma(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x), a > 0; 1 for x <= 0.

    The number of steps grows with the root of the larger argument, as either expansion needs near x = a.
    """


    def at(v: Column) -> Column:
        a, x, steps = v["a"], v["x"], (F.lit(120) + 12 * F.sqrt(F.greatest(v["a"], v["x"]))).cast("int")
        return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), 1 - _lower_series(a, x, steps))).otherwise(_upper_fraction(a, x, steps))

    return let(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), at)


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X >= x) of chi-square with ``df`` degrees of freedom; NaN without any."""
    return F.when(df > 0, upper_gamma(F.when(df > 0, df).otherwise(1) / 2.0, x / 2.0)).otherwise(float("nan"))


def _log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def exact_two_by_two(k: Column, row: Column, column: Column, n: Column) -> Column:
    """Two-sided p of a 2 x 2 table with ``k`` in the cell of a row total and a column total of ``n``: the sum over all
    tables with these totals that are no likelier than this one (likelihoods within 1e-7 count as equal)."""
    k, row, column, n = (c.cast("double") for c in (k, row, column, n))
    log_p = lambda i: _log_choose(column, i) + _log_choose(n - column, row - i) - _log_choose(n, row)
    low, high = F.greatest(F.lit(0.0), row + column - n).cast("long"), F.least(row, column).cast("long")
    total = let(log_p(k), lambda own: F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, i: let(log_p(i.cast("double")), lambda p: acc + F.when(p <= own + 1e-7, F.exp(p)).otherwise(0.0))))
    return F.least(F.lit(1.0), total)


#: Steps of the beta fraction that are enough when a parameter is a half at most, however large the other: the upper tail of a normal square. 40 give
#: all digits for 1 to 10^7 degrees of freedom.
_HALF_STEPS = 60


def beta_steps(a: Column, b: Column) -> Column:
    """Steps of the fraction of ``lower_beta``: they grow with the root of the larger parameter, unless the other is a half at most."""
    steps = 30 + 2 * F.sqrt(F.greatest(a, b))
    return F.when(F.least(a, b) <= 0.5, F.least(steps, F.lit(float(_HALF_STEPS)))).otherwise(steps).cast("int")


def lower_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), a and b > 0: its continued fraction on the side on which it converges fast.

    The number of steps is that of ``beta_steps``.
    """

    def near(v: Column) -> Column:
        """I_x(a, b) of a struct (x, y = 1 - x, a, b); the fraction's coefficients come in pairs, evaluated from the last pair up."""
        x, y, a, b = (v[c] for c in "xyab")
        steps = beta_steps(a, b)
        even = lambda m: m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = lambda m: -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = F.aggregate(F.sequence(F.lit(0), steps - 1), F.lit(0.0), lambda acc, i: let((steps - i).cast("double"), lambda m: even(m) / (1 + odd(m) / (1 + acc))))
        front = F.exp(a * F.ln(x) + b * F.ln(y) - F.ln(a) - log_gamma(a) - log_gamma(b) + log_gamma(a + b))
        return front / (1 + odd(F.lit(0.0)) / (1 + tail))

    def at(v: Column) -> Column:
        x, a, b = v["x"], v["a"], v["b"]
        side = lambda x, y, a, b: let(F.struct(x.alias("x"), y.alias("y"), a.alias("a"), b.alias("b")), near)
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), side(x, 1 - x, a, b)).otherwise(1 - side(1 - x, x, b, a))

    return let(F.struct(x.cast("double").alias("x"), a.cast("double").alias("a"), b.cast("double").alias("b")), at)


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t for any number of degrees of freedom, in a bounded number of steps; NaN for NaN."""
    n = df.cast("double")
    # 1 - x loses digits for small t, so the other tail is taken there
    square = t * t
    return F.when(F.isnan(t), float("nan")).otherwise(1 - lower_beta(square / (n + square), F.lit(0.5), n / 2))
