"""Joins with null-safe keys, anti and semi joins, one-row totals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match each other; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"__r_{k}" for k in keys]) if how not in ("left_semi", "left_anti") else joined


def restrict_to_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of `df` whose key occurs in `keys`; never multiplies rows."""
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of `df` without a partner in `other`."""
    return df.join(other, on, "left_anti")


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table to every row.

    The row is a scalar subquery: Spark computes it once and inlines it, so no join is planned and the
    query fails if the table should hold more than one row.
    """
    row = totals.select(F.struct(*[F.col(c) for c in totals.columns]).alias("t")).scalar()
    return df.select("*", row.alias("__totals")).select(*df.columns, "__totals.*")
