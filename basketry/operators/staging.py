"""Typing of the raw string feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.config import Settings
from basketry.functions import local_time, parse_date, parse_event_time, try_money
from basketry.functions.scalars import parse_source_time

# Leaves are read as text and then cast, so numbers may be quoted or not.
PAYLOAD_SCHEMA = (
    "price_attributes array<struct<product_base_price: string, vat_rate_in_percent: string>>, "
    "name array<struct<lang: string, value: string>>, brand_name string, item_category_en string, "
    "item_category string, number_of_units string, weight_in_grams string, "
    "time_item_created_in_source_utc string"
)
BASKET_SCHEMA = "array<struct<item_key: string, item_count: string>>"


def _localized(lang: str) -> Column:
    hits = F.filter(F.col("p.name"), lambda n: n["lang"] == lang)
    return F.get(hits, F.lit(0))["value"]


def stage_item_logs(raw: DataFrame) -> DataFrame:
    """Typed item logs; unparsable values become null instead of failing the job."""
    first_price = F.get(F.col("p.price_attributes"), F.lit(0))
    return raw.withColumn("p", F.from_json("payload", PAYLOAD_SCHEMA)).select(
        "log_item_id",
        "item_key",
        parse_event_time("time_log_created_utc").alias("time_log_created_utc"),
        _localized("en").alias("item_name_en"),
        _localized("de").alias("item_name_de"),
        F.coalesce(_localized("en"), _localized("de")).alias("item_name_preferred"),
        F.col("p.brand_name").alias("brand_name"),
        F.coalesce("p.item_category_en", "p.item_category").alias("item_category"),
        F.col("p.number_of_units").try_cast("long").alias("number_of_units"),
        F.col("p.weight_in_grams").try_cast("long").alias("weight_in_grams"),
        try_money(first_price["product_base_price"]).alias("product_base_price_gross_eur"),
        try_money(first_price["vat_rate_in_percent"]).alias("vat_rate_pct"),
        parse_source_time("p.time_item_created_in_source_utc").alias("time_item_created_in_source_utc"),
        F.col("payload").alias("payload_raw"),
    )


def stage_purchase_logs(raw: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Typed purchases with their UTC date and their local business date."""
    return raw.withColumn("ts", parse_event_time("time_order_received_utc")).select(
        "purchase_key",
        "customer_key",
        F.col("ts").alias("time_order_received_utc"),
        F.col("ts").cast("date").alias("order_date_utc"),
        local_time("ts", cfg.business_zone).cast("date").alias("order_date_berlin"),
        F.col("delivery_distance_line_meters").try_cast("long").alias("delivery_distance_line_meters"),
        try_money("service_fee").alias("service_fee_eur"),
        try_money("courier_base_fee").alias("courier_base_fee_eur"),
        try_money("total_basket_value").alias("total_basket_value_eur"),
        F.col("item_basket_description").alias("item_basket_description_raw"),
    )


def explode_basket(purchases: DataFrame, basket: str = "item_basket_description_raw") -> DataFrame:
    """One row per purchase and item; repeated items of a basket are summed, bad baskets vanish."""
    lines = purchases.select("purchase_key", F.inline(F.from_json(basket, BASKET_SCHEMA)))
    return (
        lines.select("purchase_key", "item_key", F.col("item_count").try_cast("long").alias("item_count"))
        .where(F.col("item_key").isNotNull() & (F.col("item_count") > 0))
        .groupBy("purchase_key", "item_key")
        .agg(F.sum("item_count").alias("item_count"))
    )


def stage_promos(raw: DataFrame) -> DataFrame:
    return raw.select(
        "item_key",
        parse_date("promo_start_date").alias("promo_start_date"),
        parse_date("promo_end_date").alias("promo_end_date"),
        "promo_type",
        F.col("discount_in_percentage").try_cast("long").alias("discount_pct"),
    )
