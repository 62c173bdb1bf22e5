"""Aggregate helpers that stay partial-aggregation friendly (map-side combine before a shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILE_ACCURACY = 10_000


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def sum_where(cond: Column, value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.sum(F.when(cond, v).otherwise(F.lit(0)))


def quantile(c: Column | str, percent: int, among: tuple[int, ...] = ()) -> Column:
    """Discrete quantile; the sketch is mergeable and exact up to `QUANTILE_ACCURACY` rows a group.

    Quantiles that name the same `among` share one sketch per group.
    """
    wanted = among or (percent,)
    return F.percentile_approx(c, [p / 100 for p in wanted], QUANTILE_ACCURACY)[wanted.index(percent)]


def distinct_list(c: Column | str, separator: str = ", ") -> Column:
    """Sorted distinct values as one text. Use on pre-grouped rows of a bounded domain only."""
    return F.array_join(F.array_sort(F.collect_set(c)), separator)


def sample_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """One row with the n smallest distinct values of a column as an array.

    Every task keeps at most n values before anything reaches one place, so the input may be any size.
    """
    smallest = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(n)
    return smallest.agg(F.array_sort(F.collect_list(column)).alias(column))
