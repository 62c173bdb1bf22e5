"""Top-N rankings, distinct-count roll-ups and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.functions import short_key
from basketry.operators.joins import with_totals


def top_n(df: DataFrame, order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The n first rows of a total order, optionally numbered.

    Each task keeps n candidates; the numbering window then sees n rows only.
    """
    best = df.orderBy(*order).limit(n)
    return best if rank is None else best.withColumn(rank, F.row_number().over(W.orderBy(*order)).cast("long"))


def top_products(rows: DataFrame, revenue: str, n: int, product: str = "product_name") -> DataFrame:
    """The n products with the highest revenue; only names and sums are shuffled. Rows without a name are one product."""
    sums = rows.groupBy(product).agg(F.sum(revenue).alias("__revenue"))
    return top_n(sums, [F.desc("__revenue"), F.asc_nulls_first(product)], n).select(product)


def top_n_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The n first rows of every group; the filter is pushed below the shuffle (window group limit)."""
    position = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, position).where(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("long"))


def measure_rollup(
    rows: DataFrame,
    dims: Sequence[str],
    sums: Mapping[str, Column | str],
    order_flags: Mapping[str, Column] | None = None,
    order: str = "order_sk",
    customer: str = "customer_sk",
) -> DataFrame:
    """Sums plus exact distinct orders and customers per `dims`.

    Instead of several count(distinct) in one group-by, which multiply every row, the rows are folded in
    steps: (dims, order) -> (dims, customer) -> dims. Each step combines before it shuffles, and the steps
    before the last are spread by order and by customer, so a dominant group is never one task's work.

    Output: dims, the sums, `orders`, `customers`, `repeat_customers` (customers with more than one order)
    and one column per entry of `order_flags` counting the orders in which the condition held for any row.
    """
    flags = dict(order_flags or {})
    cols = {n: (F.col(c) if isinstance(c, str) else c) for n, c in sums.items()}
    per_order = order_grain(rows, dims, cols, flags, order, customer)
    per_customer = per_order.groupBy(*dims, customer).agg(
        *[F.sum(n).alias(n) for n in cols],
        *[F.count_if(F.col(n)).alias(n) for n in flags],
        F.count(order).alias("orders"),
    )
    return per_customer.groupBy(*dims).agg(
        *[F.sum(n).alias(n) for n in cols],
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in flags],
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        F.count(customer).alias("customers"),
        F.count_if(F.col("orders") > 1).alias("repeat_customers"),
    )


def order_grain(
    rows: DataFrame,
    dims: Sequence[str],
    sums: Mapping[str, Column],
    flags: Mapping[str, Column],
    order: str = "order_sk",
    customer: str = "customer_sk",
) -> DataFrame:
    """First step of the roll-up: one row per group, order and customer, both packed as they are only counted."""
    aggs = [F.sum(c).alias(n) for n, c in sums.items()] + [F.max(c).alias(n) for n, c in flags.items()]
    keyed = rows.groupBy(*dims, short_key(rows, order), short_key(rows, customer))
    return keyed.agg(*aggs) if aggs else keyed.agg(F.count(F.lit(1)).alias("rows")).drop("rows")


def sizes(
    rows: DataFrame, count: str, distinct: Mapping[str, str], flags: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row: the number of rows, of distinct values per column, and of rows for which a condition holds.

    Several count(distinct) in one aggregate would repeat every row per column. Here the rows are folded once to the distinct
    combinations of the columns, which are then folded per column; the table is scanned once, and the fold is shared.
    """
    conditions = dict(flags or {})
    columns = list(dict.fromkeys(distinct.values()))
    if not columns:
        return rows.agg(F.count(F.lit(1)).alias(count), *[F.count_if(c).alias(n) for n, c in conditions.items()])
    held = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias(count), *[F.count_if(c).alias(n) for n, c in conditions.items()])
    named = {c: [n for n, column in distinct.items() if column == c] for c in columns}
    out = None
    for column in columns:
        sums = [count, *conditions] if out is None else []
        per_value = held.groupBy(column).agg(*([F.sum(n).alias(n) for n in sums] or [F.first(F.lit(1)).alias("__one")]))
        size = per_value.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums], *[F.count(column).alias(n) for n in named[column]])
        out = size if out is None else with_totals(out, size)
    return out


def kpi_long(df: DataFrame, ids: Sequence[str], metrics: Mapping[str, str], name: str, value: str) -> DataFrame:
    """Wide metrics to (ids, name, value) rows in one scan; `metrics` maps label to column."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(label) for label, c in metrics.items()])
    return wide.unpivot(list(ids), list(metrics), name, value)
