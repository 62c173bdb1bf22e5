"""Dimensional core: prices and promotions on order items, facts, dimensions and their refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.config import Settings
from basketry.functions import local_time, sunday_week, surrogate_key
from basketry.operators.enrich import decompose_amounts, orders_with_rollups
from basketry.operators.history import HISTORY_COLUMNS, version_key
from basketry.operators.joins import restrict_to_keys
from basketry.operators.temporal import SEGMENT_COLUMNS, VERSION_ATTRIBUTES, apply_promo_segments, promo_segments, time_valid_join
from basketry.operators.upsert import upsert
from basketry.sources.sinks import ORDER_EXPORT, ORDER_ITEM_EXPORT

PROMO_KEY = ("item_key", "promo_start_date", "promo_end_date", "promo_type", "discount_pct")


def with_promo_key(promos: DataFrame) -> DataFrame:
    return promos.withColumn("promo_sk", surrogate_key(*PROMO_KEY))


def keyed_promo_segments(promos: DataFrame) -> DataFrame:
    return promo_segments(with_promo_key(promos))


def order_lines(basket_items: DataFrame, purchases: DataFrame) -> DataFrame:
    """Order items of curated purchases, without the columns that can be worked out from others."""
    buys = purchases.select(
        "purchase_key", "customer_key", "time_order_received_utc", "order_date_utc", "order_date_berlin"
    )
    return basket_items.join(buys, "purchase_key").select(
        *buys.columns, "item_key", F.col("item_count").alias("units_in_order_item_row")
    )


def with_line_keys(lines: DataFrame) -> DataFrame:
    """Order items with their surrogate keys in front; hex keys are longer than the rest of a row, so they are made after it has moved."""
    return lines.select(
        surrogate_key("purchase_key", "item_key").alias("order_item_sk"),
        surrogate_key("purchase_key").alias("order_sk"),
        surrogate_key("customer_key").alias("customer_sk"),
        *lines.columns,
    )


def order_items_with_price(
    basket_items: DataFrame,
    purchases: DataFrame,
    history: DataFrame,
    cfg: Settings = Settings(),
    strategy: str = "auto",
    disjoint: bool = False,
) -> DataFrame:
    """Order items of curated purchases with the item version valid when the order was placed.

    `disjoint`: the history is known to have no overlapping versions, as one that `item_scd2` built.
    """
    priced = time_valid_join(order_lines(basket_items, purchases), history, cfg=cfg, strategy=strategy, disjoint=disjoint)
    return with_line_keys(priced.withColumnRenamed("product_base_price_gross_eur", "item_unit_base_price_gross_eur"))


def order_items_with_promo(priced: DataFrame, segments: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Priced order items with their best promotion and all amounts."""
    return decompose_amounts(apply_promo_segments(priced, segments, cfg=cfg))


# what a stored order item keeps of its item version; the rest of the version follows from it
STORED_VERSION = tuple(a for a in VERSION_ATTRIBUTES if a not in ("item_key_sk", "item_scd_sk")) + ("log_item_id",)


def promoted_rows(
    basket_items: DataFrame, purchases: DataFrame, history: DataFrame, segments: DataFrame, cfg: Settings = Settings()
) -> DataFrame:
    """Order items with their item version and best promotion, without the columns that `promoted_columns` works out from them.

    `history` is as `item_scd2` builds it. The promotion is looked up first, while rows are short.
    """
    promoted = apply_promo_segments(order_lines(basket_items, purchases), segments, cfg=cfg)
    return time_valid_join(promoted, history, attributes=STORED_VERSION, cfg=cfg, disjoint=True).withColumnRenamed(
        "product_base_price_gross_eur", "item_unit_base_price_gross_eur"
    )


def promoted_columns(rows: DataFrame) -> DataFrame:
    """All columns of `order_items_with_promo(order_items_with_price(...))` from what `promoted_rows` keeps."""
    found = F.col("valid_from_utc").isNotNull()
    keys = {
        "item_key_sk": F.when(found, surrogate_key("item_key")),
        "item_scd_sk": F.when(found, version_key("valid_from_utc")),
    }
    renamed = {"product_base_price_gross_eur": "item_unit_base_price_gross_eur"}
    version = [keys[a].alias(a) if a in keys else F.col(renamed.get(a, a)) for a in VERSION_ATTRIBUTES]
    line = [c for c in rows.columns if c not in (*STORED_VERSION, *renamed.values(), *SEGMENT_COLUMNS)]
    return decompose_amounts(with_line_keys(rows.select(*line, *version, *SEGMENT_COLUMNS)))


def fct_order_item(promoted: DataFrame) -> DataFrame:
    return promoted.withColumnsRenamed(
        {"time_order_received_utc": "order_ts_utc", "order_date_berlin": "order_date"}
    ).select(*ORDER_ITEM_EXPORT)


def fct_order(rollups: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    local = local_time("time_order_received_utc", cfg.business_zone)
    return (
        rollups.withColumn("order_ts_berlin", local)
        .withColumn("order_hour_utc", F.hour("time_order_received_utc").cast("long"))
        .withColumn("order_hour_berlin", F.hour("order_ts_berlin").cast("long"))
        .withColumn("order_day_name", F.date_format("order_date_berlin", "EEEE"))
        .withColumnsRenamed({"time_order_received_utc": "order_ts_utc", "order_date_berlin": "order_date"})
        .select(*ORDER_EXPORT)
    )


def dim_date(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day of [start, end]; also the time spine of the metric layer."""
    bounds = spark.range(1).select(F.lit(start).cast("date").alias("lo"), F.lit(end).cast("date").alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date_day"))
    day = F.col("date_day")
    return days.select(
        day,
        F.year(day).cast("long").alias("year"),
        F.quarter(day).cast("long").alias("quarter"),
        F.month(day).cast("long").alias("month"),
        sunday_week(day).alias("week"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        F.dayofweek(day).isin(1, 7).alias("is_weekend"),
    )


def dim_item_history(scd2: DataFrame) -> DataFrame:
    return scd2.select(*HISTORY_COLUMNS)


def dim_item_current(history: DataFrame, cutoff=None) -> DataFrame:
    """Current version of each item; with a cutoff only items that changed since."""
    current = history.where("is_current").select(
        "item_key",
        "item_key_sk",
        "item_scd_sk",
        "item_name_en",
        "item_name_de",
        "item_name_preferred",
        "item_category",
        "brand_name",
        "number_of_units",
        "weight_in_grams",
        F.col("product_base_price_gross_eur").alias("current_product_base_price_gross_eur"),
        F.col("vat_rate_pct").alias("current_vat_rate_pct"),
        F.col("valid_from_utc").alias("current_valid_from_utc"),
    )
    if cutoff is None:
        return current
    changed = history.where(F.col("valid_from_utc") >= F.lit(cutoff)).select("item_key_sk")
    return restrict_to_keys(current, changed, "item_key_sk")


def dim_promo(promos: DataFrame) -> DataFrame:
    """One row per promotion rule; exact repeats of a rule share its key and fold into one."""
    return (
        with_promo_key(promos)
        .withColumn("item_key_sk", surrogate_key("item_key"))
        .select("promo_sk", "item_key_sk", "item_key", "promo_type", "discount_pct", "promo_start_date", "promo_end_date")
        .distinct()
    )


def dim_customer(orders: DataFrame, cutoff=None) -> DataFrame:
    """One row per customer; with a cutoff only customers with an order since, from all their orders."""
    rows = orders.select(
        "customer_sk",
        "customer_key",
        "order_ts_utc",
        "total_basket_value_eur",
        "has_any_promo_units_in_order",
        "is_first_order_for_customer",
    )
    if cutoff is not None:
        recent = rows.where(F.col("order_ts_utc") >= F.lit(cutoff)).select("customer_sk")
        rows = restrict_to_keys(rows, recent, "customer_sk")
    promo = F.col("has_any_promo_units_in_order")
    return rows.groupBy("customer_sk").agg(
        F.min("customer_key").alias("customer_key"),
        F.min("order_ts_utc").alias("first_order_ts_utc"),
        F.max("order_ts_utc").alias("last_order_ts_utc"),
        F.count(F.lit(1)).alias("lifetime_orders"),
        F.sum("total_basket_value_eur").alias("lifetime_basket_value_eur"),
        F.count_if(promo).alias("orders_with_promo"),
        F.max(F.col("is_first_order_for_customer") & promo).alias("first_order_contains_promo_flag"),
    )


# ------------------------------------------------------------------------------- incremental refreshes


def refresh_fct_order(
    target: DataFrame, purchases: DataFrame, promoted: DataFrame, cutoff, cfg: Settings = Settings()
) -> DataFrame:
    """Upsert every order of the customers who ordered since the cutoff.

    A late order renumbers the later orders of its customer, so those are restated with it. Both inputs are
    cut down to these customers before anything is sorted or rolled up.
    """
    keyed = purchases.withColumn("customer_sk", surrogate_key("customer_key"))
    recent = keyed.where(F.col("time_order_received_utc") >= F.lit(cutoff)).select("customer_sk").distinct()
    theirs = restrict_to_keys(keyed, recent, "customer_sk").drop("customer_sk")
    items = restrict_to_keys(promoted, recent, "customer_sk")
    return upsert(target, fct_order(orders_with_rollups(theirs, items, cfg), cfg), ["order_sk"])


def refresh_fct_order_item(target: DataFrame, promoted: DataFrame, cutoff) -> DataFrame:
    fresh = promoted.where(F.col("time_order_received_utc") >= F.lit(cutoff))
    return upsert(target, fct_order_item(fresh), ["order_item_sk"])


def refresh_dim_customer(target: DataFrame, orders: DataFrame, cutoff) -> DataFrame:
    return upsert(target, dim_customer(orders, cutoff), ["customer_sk"])


def refresh_dim_item_current(target: DataFrame, history: DataFrame, cutoff) -> DataFrame:
    return upsert(target, dim_item_current(history, cutoff), ["item_key_sk"])


def refresh_dim_promo(target: DataFrame, promos: DataFrame) -> DataFrame:
    return upsert(target, dim_promo(promos), ["promo_sk"])
