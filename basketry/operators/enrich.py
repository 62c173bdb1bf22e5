"""Money decomposition of order items and roll-ups to the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.config import Settings
from basketry.functions import key_text, sum_where, surrogate_key
from basketry.functions.scalars import MONEY
from basketry.operators.timeline import hot_and_busy, split_row_number


def decompose_amounts(df: DataFrame) -> DataFrame:
    """Base, discount and final amount per unit and per row, in exact decimals.

    A row without a price counts as zero; a row without a promotion has discount 0.
    """
    price = F.coalesce(F.col("item_unit_base_price_gross_eur"), F.lit(0).cast(MONEY))
    units = F.col("units_in_order_item_row").cast("decimal(18,0)")
    pct = F.coalesce(F.col("discount_pct"), F.lit(0)).cast("long")
    # integer percent times 0.01 is exact, a division would not be
    share = pct.cast("decimal(9,0)") * F.lit("0.01").cast("decimal(3,2)")
    base = (price * units).cast(MONEY)
    unit_discount = (price * share).cast(MONEY)
    row_discount = (base * share).cast(MONEY)
    return df.select(
        *[c for c in df.columns if c != "discount_pct"],
        pct.alias("discount_pct_applied"),
        (pct > 0).alias("is_promo_item"),
        base.alias("order_item_row_base_amount_gross_eur"),
        unit_discount.alias("item_unit_discount_amount_gross_eur"),
        (price - unit_discount).cast(MONEY).alias("item_unit_final_price_gross_eur"),
        row_discount.alias("order_item_row_discount_amount_gross_eur"),
        (base - row_discount).cast(MONEY).alias("order_item_row_final_amount_gross_eur"),
    )


ORDER_COLUMNS = (
    "purchase_key",
    "customer_key",
    "time_order_received_utc",
    "order_date_utc",
    "order_date_berlin",
    "delivery_distance_line_meters",
    "total_basket_value_eur",
    "service_fee_eur",
    "courier_base_fee_eur",
)


def totals() -> list[Column]:
    with_service = F.col("total_basket_value_eur") + F.col("service_fee_eur")
    return [
        with_service.cast(MONEY).alias("basket_plus_service_fee_eur"),
        (with_service + F.col("courier_base_fee_eur")).cast(MONEY).alias("total_customer_paid_eur"),
    ]


def order_totals(purchases: DataFrame) -> DataFrame:
    """What the customer paid: basket plus service fee, and plus courier fee."""
    return purchases.select(
        surrogate_key("purchase_key").alias("order_sk"),
        surrogate_key("customer_key").alias("customer_sk"),
        *ORDER_COLUMNS,
        *totals(),
    )


ROLLUP_SUMS = {
    "derived_order_items_base_amount_gross_eur": "order_item_row_base_amount_gross_eur",
    "derived_order_items_discount_amount_gross_eur": "order_item_row_discount_amount_gross_eur",
    "derived_order_items_final_amount_gross_eur": "order_item_row_final_amount_gross_eur",
}


def order_item_sums(promoted: DataFrame, *keys: Column | str) -> DataFrame:
    promo = F.col("is_promo_item")
    return promoted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_order_item_rows_in_order"),
        F.sum("units_in_order_item_row").alias("total_units_in_order"),
        F.count_if(promo).alias("promo_order_item_rows_in_order"),
        sum_where(promo, "units_in_order_item_row").alias("promo_units_in_order"),
        *[F.sum(src).alias(name) for name, src in ROLLUP_SUMS.items()],
    )


def order_item_rollup(promoted: DataFrame) -> DataFrame:
    return order_item_sums(promoted, "order_sk")


def customer_sequence(orders: DataFrame, unit: str = "hour", rows_per_task: int = 1_000_000, customer: str = "customer_sk") -> DataFrame:
    """Running order number per customer by time, then purchase key; orders without a customer are one customer's."""
    keys, ts = [customer], "time_order_received_utc"
    crowded = hot_and_busy(orders, keys, ts, unit, rows_per_task)
    return split_row_number(orders, keys, ts, ["purchase_key"], "customer_order_number", unit, **crowded)


ORDER_COUNTS = (
    "total_units_in_order",
    "distinct_order_item_rows_in_order",
    "promo_order_item_rows_in_order",
    "promo_units_in_order",
)


def rollup_rows(purchases: DataFrame, promoted: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Orders with their item roll-up (zero where an order has no items) and number, without what `rollup_columns` works out.

    Orders are numbered and joined by the text their keys are made of, which is shorter than the keys.
    """
    rollup = order_item_sums(promoted, key_text("purchase_key").alias("__order"))
    keyed = purchases.select(*ORDER_COLUMNS, key_text("customer_key").alias("__customer"))
    sequenced = customer_sequence(keyed, cfg.split_unit, cfg.rows_per_task, "__customer")
    joined = sequenced.join(rollup, key_text("purchase_key") == F.col("__order"), "left")
    return joined.select(
        *ORDER_COLUMNS,
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ORDER_COUNTS],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ROLLUP_SUMS],
        "customer_order_number",
    )


def rollup_columns(rows: DataFrame) -> DataFrame:
    """All columns of `orders_with_rollups` from what `rollup_rows` keeps."""
    rest = [F.col(c) for c in (*ORDER_COUNTS, *ROLLUP_SUMS, "customer_order_number")]
    return rows.select(
        surrogate_key("purchase_key").alias("order_sk"),
        surrogate_key("customer_key").alias("customer_sk"),
        *ORDER_COLUMNS,
        *totals(),
        *rest,
        (F.col("customer_order_number") == 1).alias("is_first_order_for_customer"),
        (F.col("promo_units_in_order") > 0).alias("has_any_promo_units_in_order"),
    )


def orders_with_rollups(purchases: DataFrame, promoted: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Orders with their item roll-up (zero where an order has no items) and customer lifecycle."""
    return rollup_columns(rollup_rows(purchases, promoted, cfg))
