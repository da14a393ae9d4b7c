"""Counts at several grains in one pass, with quantiles by a mergeable sketch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sketch's rank is off by at most one part in so many.
ACCURACY = 1_000


def by_grains(rows: DataFrame, grains: Sequence[Sequence[str]], value: str, distinct: str | None = None, quantiles: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int = ACCURACY) -> DataFrame:
    """n, n_values, least, most, ``n_distinct`` of a column and quantiles of ``value`` for each group of each grain.

    A grain is a list of columns; columns that a row's grain lacks are null, and ``grain`` names its own, so that a null key is told from
    a missing one. One expand and one aggregation with partial sums; the quantiles are exact values of the column whose rank is off by at
    most n / ``accuracy``, from sketches that merge, so no group meets in one task before it is summed. NaN and null
    values do not count as values.
    """
    keys = list(dict.fromkeys(c for g in grains for c in g))
    real = F.when(~F.isnan(value), F.col(value))
    aggregates = [F.count("*").alias("n"), F.count(real).alias("n_values"), F.min(real).alias("least"), F.max(real).alias("most"), F.percentile_approx(real, list(quantiles), accuracy).alias("quantiles")]
    if distinct:
        aggregates.append(F.count_distinct(distinct).alias("n_distinct"))
    lists = [[F.col(c) for c in g] for g in grains]
    names = F.concat_ws(",", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in keys)).alias("grain")
    return rows.groupingSets(lists, *(F.col(c) for c in keys)).agg(names, *aggregates)
