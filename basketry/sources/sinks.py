"""Exports and table layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the exports in order.
ORDER_EXPORT = [
    "order_sk",
    "customer_sk",
    "purchase_key",
    "customer_key",
    "order_ts_utc",
    "order_ts_berlin",
    "order_date_utc",
    "order_date",
    "order_hour_utc",
    "order_hour_berlin",
    "order_day_name",
    "delivery_distance_line_meters",
    "total_basket_value_eur",
    "service_fee_eur",
    "courier_base_fee_eur",
    "basket_plus_service_fee_eur",
    "total_customer_paid_eur",
    "total_units_in_order",
    "distinct_order_item_rows_in_order",
    "promo_order_item_rows_in_order",
    "promo_units_in_order",
    "has_any_promo_units_in_order",
    "derived_order_items_base_amount_gross_eur",
    "derived_order_items_discount_amount_gross_eur",
    "derived_order_items_final_amount_gross_eur",
    "customer_order_number",
    "is_first_order_for_customer",
]
ORDER_ITEM_EXPORT = [
    "order_item_sk",
    "order_sk",
    "customer_sk",
    "purchase_key",
    "customer_key",
    "item_key",
    "item_key_sk",
    "item_scd_sk",
    "promo_sk",
    "order_ts_utc",
    "order_date_utc",
    "order_date",
    "units_in_order_item_row",
    "item_unit_base_price_gross_eur",
    "discount_pct_applied",
    "item_unit_discount_amount_gross_eur",
    "item_unit_final_price_gross_eur",
    "order_item_row_base_amount_gross_eur",
    "order_item_row_discount_amount_gross_eur",
    "order_item_row_final_amount_gross_eur",
    "is_promo_item",
    "item_name_en",
    "item_name_de",
    "item_name_preferred",
    "item_category",
    "brand_name",
    "vat_rate_pct",
]
CUSTOMER_PROMO_EXPORT = [
    "customer_sk",
    "customer_key",
    "first_order_ts_utc",
    "first_order_ts_berlin",
    "first_order_had_any_promo_units",
    "first_order_had_only_promo_units",
    "orders_with_any_promo_units",
    "orders_with_no_promo_units",
    "promo_units_purchased",
    "non_promo_units_purchased",
    "promo_value_eur",
    "non_promo_value_eur",
    "promo_only_customer_flag",
    "lifetime_orders",
]
PAIR_EXPORT = [
    "product_a",
    "product_b",
    "pair_orders",
    "product_a_orders",
    "product_b_orders",
    "total_orders",
    "support",
    "expected_support_independent",
    "expected_pair_orders_independent",
    "pair_orders_vs_expected_delta",
    "pair_orders_vs_expected_pct",
    "confidence_a_to_b",
    "confidence_b_to_a",
    "lift",
    "category_a",
    "category_b",
    "pattern",
    "actionability_bucket",
    "actionability_rank",
]


def ordered_csv(df: DataFrame, path: str, order: Sequence[Column | str]) -> DataFrame:
    """Write CSV part files whose concatenation in name order is globally sorted.

    The sort is a range shuffle, so every task writes its own slice; nothing is funnelled into one file.
    """
    out = df.orderBy(*order)
    # blanks are part of a value; the writer would cut them off
    writer = out.write.mode("overwrite").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return out


def read_ordered(spark: SparkSession, path: str, schema: T.StructType, position: str = "position") -> DataFrame:
    """The rows of an ordered export with their place in it: files by name, then lines.

    Nothing is gathered: a row's place is its place in the piece of a file that one task reads, plus the rows of the pieces
    before. Only a row per piece (file name, first byte) is sorted in one place.
    """
    read = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    piece = [F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__byte")]
    rows = read.select("*", *piece).withColumn("__id", F.monotonically_increasing_id())
    pieces = rows.groupBy("__file", "__byte").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    earlier = W.orderBy("__file", "__byte").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    place = (F.col("__start") + F.col("__id") - F.col("__first") + 1).cast("long")
    return rows.join(starts, ["__file", "__byte"]).select(*[f.name for f in schema.fields], place.alias(position))


def export_orders(orders: DataFrame, path: str) -> DataFrame:
    return ordered_csv(orders.select(*ORDER_EXPORT), path, ["order_ts_utc", "order_sk"])


def export_order_items(items: DataFrame, path: str) -> DataFrame:
    return ordered_csv(items.select(*ORDER_ITEM_EXPORT), path, ["order_ts_utc", "order_item_sk"])


def export_category_kpis(kpi_long: DataFrame, path: str) -> DataFrame:
    out = kpi_long.select("order_month", "metric_name", "item_category", "metric_value")
    return ordered_csv(out, path, ["order_month", "item_category", "metric_name"])


def export_category_scorecard(scorecard: DataFrame, path: str) -> DataFrame:
    return ordered_csv(scorecard, path, [F.desc("revenue_eur"), F.asc_nulls_first("category")])


def export_customer_promo(behavior: DataFrame, path: str) -> DataFrame:
    return ordered_csv(behavior.select(*CUSTOMER_PROMO_EXPORT), path, ["customer_sk"])


def export_pair_affinity(pairs: DataFrame, path: str) -> DataFrame:
    order = ["actionability_rank", F.desc("lift"), F.desc("pair_orders"), "product_a", "product_b"]
    return ordered_csv(pairs.select(*PAIR_EXPORT), path, order)


# Layout of each stored table: (date column, grain of the partition, sort keys inside files).
LAYOUTS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "fct_order": ("order_date", "day", ("order_sk", "customer_sk")),
    "fct_order_item": ("order_date", "day", ("order_sk", "item_key_sk", "customer_sk")),
    "int_promoted": ("order_date_berlin", "day", ("order_sk", "item_key_sk", "customer_sk")),
    "int_purchases": ("order_date_utc", "day", ("purchase_key", "customer_key")),
    "int_item_logs": ("time_log_created_utc", "day", ("item_key",)),
    "dim_item_history": ("valid_from_utc", "day", ("item_key_sk", "is_current")),
    "dim_promo": ("promo_start_date", "day", ("item_key_sk", "promo_type")),
    "rpt_category_monthly": ("order_month", "day", ("item_category",)),
    "rpt_kpi_long": ("order_month", "day", ("metric_name", "item_category")),
    "rpt_kpi_mom": ("order_month", "day", ("metric_name", "item_category")),
}
PARTITION_COLUMN = "part_date"


def write_layout(
    df: DataFrame,
    path: str,
    date_column: str,
    sort_keys: Sequence[str],
    grain: str = "day",
    mode: str = "overwrite",
) -> DataFrame:
    """Date-partitioned Parquet with rows sorted by key inside each file.

    A date column partitions by itself, so filters on it prune; months and timestamps get a `part_date`.
    The rebalance hint lets adaptive execution split a date that is too large for one task and merge dates
    that are too small, so file sizes follow the advisory partition size instead of the calendar.
    """
    if grain == "day" and isinstance(df.schema[date_column].dataType, T.DateType):
        out, partition = df, date_column
    else:
        day = F.col(date_column).cast("date")
        out, partition = df.withColumn(PARTITION_COLUMN, F.trunc(day, "month") if grain == "month" else day), PARTITION_COLUMN
    (
        out.hint("rebalance", partition)
        .sortWithinPartitions(partition, *sort_keys)
        .write.mode(mode)
        # only the dates present in this write are replaced
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    return df.sparkSession.read.schema(out.schema).parquet(path).select(*out.columns)


def write_table_layout(df: DataFrame, path: str, table: str) -> DataFrame:
    """Store a table in its declared layout; the result has the columns of the input."""
    column, grain, keys = LAYOUTS[table]
    return write_layout(df, path, column, keys, grain).select(*df.columns)
