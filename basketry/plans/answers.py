"""Answer queries on the facts and reporting marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.functions import count_where, local_time, quantile, safe_divide, short_key, sum_where
from basketry.operators.ranking import measure_rollup, top_n_per_group
from basketry.plans.reporting import BASE, FIRST, REPEAT, REVENUE, UNITS


def between(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows with start <= column <= end; a missing bound is open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def service_area(orders: DataFrame) -> DataFrame:
    """How far the store delivers, per day."""
    d = "delivery_distance_line_meters"
    return (
        orders.groupBy("order_date")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.avg(d).alias("avg_delivery_distance_m"),
            F.min(d).alias("min_delivery_distance_m"),
            F.max(d).alias("max_delivery_distance_m"),
            quantile(d, 50, (50, 90)).alias("p50_delivery_distance_m"),
            quantile(d, 90, (50, 90)).alias("p90_delivery_distance_m"),
        )
        .orderBy("order_date")
    )


def items_and_prices(items: DataFrame) -> DataFrame:
    """What is bought at which weighted price, per day and item."""
    keys = ["order_date", "item_key", "item_name_preferred", "item_category"]
    rolled = items.groupBy(*keys).agg(
        F.sum(UNITS).alias("units_sold"), F.sum(REVENUE).alias("final"), F.sum(BASE).alias("base")
    )
    return rolled.select(
        *keys,
        "units_sold",
        safe_divide("final", "units_sold").alias("weighted_avg_selling_price_eur"),
        safe_divide("base", "units_sold").alias("weighted_avg_base_price_eur"),
    ).orderBy("order_date", F.desc("units_sold"), "item_key")


def promo_units_by_day(items: DataFrame) -> DataFrame:
    rolled = items.groupBy("order_date").agg(
        sum_where(F.col("is_promo_item"), UNITS).alias("promo_units_sold"), F.sum(UNITS).alias("total_units_sold")
    )
    share = safe_divide("promo_units_sold", "total_units_sold")
    return rolled.withColumn("promo_unit_share", share).orderBy("order_date")


def promo_adoption(behavior: DataFrame) -> DataFrame:
    """Promotion rates per customer."""
    all_units = F.col("promo_units_purchased") + F.col("non_promo_units_purchased")
    return behavior.select(
        "customer_sk",
        "customer_key",
        "lifetime_orders",
        "orders_with_any_promo_units",
        "orders_with_no_promo_units",
        "promo_units_purchased",
        "non_promo_units_purchased",
        "promo_value_eur",
        "non_promo_value_eur",
        safe_divide("orders_with_any_promo_units", "lifetime_orders").alias("promo_order_rate"),
        safe_divide(F.col("promo_units_purchased"), all_units).alias("promo_unit_share"),
        "promo_only_customer_flag",
    ).orderBy(F.desc("promo_order_rate"), F.desc("promo_units_purchased"), "customer_sk")


def repeat_behavior(orders: DataFrame) -> DataFrame:
    """One row: one-time and repeat customers."""
    per_customer = orders.groupBy("customer_sk").agg(F.count(F.lit(1)).alias("n"))
    return per_customer.agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_where(F.col("n") == 1).alias("one_time_customers"),
        count_where(F.col("n") > 1).alias("repeat_customers"),
        safe_divide(count_where(F.col("n") > 1), F.count(F.lit(1))).alias("repeat_customer_rate"),
        F.avg("n").alias("avg_orders_per_customer"),
    )


def fees_vs_basket(orders: DataFrame) -> DataFrame:
    rolled = orders.groupBy("order_date").agg(
        F.sum("total_basket_value_eur").alias("basket_value_eur"),
        F.sum("service_fee_eur").alias("service_fee_eur"),
        F.sum("courier_base_fee_eur").alias("courier_base_fee_eur"),
        F.sum(F.col("service_fee_eur") + F.col("courier_base_fee_eur")).alias("fees"),
    )
    return rolled.select(
        "order_date",
        "basket_value_eur",
        "service_fee_eur",
        "courier_base_fee_eur",
        safe_divide("service_fee_eur", "basket_value_eur").alias("service_fee_to_basket_ratio"),
        safe_divide("courier_base_fee_eur", "basket_value_eur").alias("courier_fee_to_basket_ratio"),
        safe_divide("fees", "basket_value_eur").alias("total_fee_to_basket_ratio"),
    ).orderBy("order_date")


def revenue_by_day(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("order_date")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("total_customer_paid_eur").alias("total_customer_paid_revenue_proxy_eur"),
            F.sum("total_basket_value_eur").alias("basket_revenue_component_eur"),
            F.sum("service_fee_eur").alias("service_fee_component_eur"),
            F.sum("courier_base_fee_eur").alias("courier_fee_component_eur"),
        )
        .orderBy("order_date")
    )


def courier_cost_by_day(orders: DataFrame) -> DataFrame:
    fee = "courier_base_fee_eur"
    return (
        orders.groupBy("order_date")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum(fee).alias("courier_cost_eur"),
            safe_divide(F.sum(fee), F.count(fee)).alias("avg_courier_cost_per_order_eur"),
        )
        .orderBy("order_date")
    )


def best_categories(monthly: DataFrame, items: DataFrame) -> DataFrame:
    """Categories by revenue with the product that earns most in each."""
    ranked = monthly.groupBy("item_category").agg(
        F.sum("order_item_rows_revenue_eur").alias("revenue"), F.sum("units_sold").alias("units")
    )
    products = items.groupBy("item_category", "item_key", "item_name_preferred").agg(
        F.sum(REVENUE).alias("star_revenue"), F.sum(UNITS).alias("star_units")
    )
    star = top_n_per_group(products, ["item_category"], [F.desc("star_revenue"), F.asc("item_key")], 1)
    return (
        ranked.join(star, "item_category", "left")
        .select(
            "item_category",
            F.col("revenue").alias("category_revenue_eur"),
            F.col("units").alias("category_units_sold"),
            safe_divide("revenue", "units").alias("category_weighted_avg_selling_price_eur"),
            F.col("item_key").alias("star_item_key"),
            F.col("item_name_preferred").alias("star_item_name"),
            F.col("star_revenue").alias("star_item_revenue_eur"),
            F.col("star_units").alias("star_item_units_sold"),
        )
        .orderBy(F.desc("category_revenue_eur"), "item_category")
    )


def _by_month(column: str = "order_month"):
    # one row per category and month: a group is as long as the calendar
    return W.partitionBy("item_category").orderBy(column)


def declining_categories(monthly: DataFrame) -> DataFrame:
    """Category months whose revenue fell, with price, volume and promotion next to it."""
    w = _by_month()
    price = "weighted_avg_selling_price_eur"
    lagged = monthly.select(
        "order_month",
        "item_category",
        F.col("order_item_rows_revenue_eur").alias("revenue_eur"),
        "units_sold",
        "promo_units_sold",
        price,
        F.col("avg_order_units_for_orders_with_category").alias("avg_order_units"),
    )
    lagged = (
        lagged.withColumn("prev_revenue_eur", F.lag("revenue_eur").over(w))
        .withColumn("prev_units_sold", F.lag("units_sold").over(w))
        .withColumn(f"prev_{price}", F.lag(price).over(w))
    )
    return (
        lagged.where(F.col("revenue_eur") < F.col("prev_revenue_eur"))
        .select(
            "order_month",
            "item_category",
            "revenue_eur",
            "prev_revenue_eur",
            (F.col("revenue_eur") - F.col("prev_revenue_eur")).alias("revenue_mom_change_eur"),
            "units_sold",
            "prev_units_sold",
            (F.col("units_sold") - F.col("prev_units_sold")).alias("units_mom_change"),
            price,
            f"prev_{price}",
            (F.col(price) - F.col(f"prev_{price}")).alias("weighted_asp_mom_change_eur"),
            "promo_units_sold",
            safe_divide("promo_units_sold", "units_sold").alias("promo_unit_share"),
            "avg_order_units",
        )
        .orderBy(F.desc("order_month"), "revenue_mom_change_eur", "item_category")
    )


def pair_affinity(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "product_a",
        "category_a",
        "product_b",
        "category_b",
        "pair_orders",
        "support",
        "confidence_a_to_b",
        "confidence_b_to_a",
        "lift",
        "expected_pair_orders_independent",
        "pair_orders_vs_expected_delta",
        "actionability_bucket",
    ).orderBy(pairs["actionability_rank"], F.desc("lift"), F.desc("pair_orders"), "product_a", "product_b")


def consumption_by_time(items: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """Category by local weekday and hour; day and hour come from the item row's own order time."""
    rows = items.select(
        F.date_format("order_date", "EEEE").alias("order_day_name"),
        F.hour(local_time("order_ts_utc", zone)).cast("long").alias("order_hour_berlin"),
        "item_category",
        "order_sk",
        "customer_sk",
        F.col(UNITS).alias("units"),
        F.col(REVENUE).alias("revenue"),
    )
    keys = ["order_day_name", "order_hour_berlin", "item_category"]
    rolled = measure_rollup(rows, keys, {"units_sold": "units", "revenue_eur": "revenue"})
    return rolled.select(*keys, "orders", "customers", "units_sold", "revenue_eur").orderBy(
        "item_category", "order_day_name", "order_hour_berlin"
    )


def promo_acquisition(behavior: DataFrame) -> DataFrame:
    """One row: how many customers came through a promotion and how many buy nothing else."""
    n = F.count(F.lit(1))
    any_promo = count_where(F.col("first_order_had_any_promo_units"))
    only_promo = count_where(F.col("first_order_had_only_promo_units"))
    always = count_where(F.col("promo_only_customer_flag"))
    return behavior.agg(
        n.alias("customers_total"),
        any_promo.alias("customers_first_order_with_promo_units"),
        safe_divide(any_promo, n).alias("first_order_promo_acquisition_rate"),
        only_promo.alias("customers_first_order_only_promo_units"),
        safe_divide(only_promo, n).alias("first_order_only_promo_rate"),
        always.alias("customers_always_promo_only"),
        safe_divide(always, n).alias("lifetime_promo_only_customer_rate"),
    )


def _monthly_base(monthly: DataFrame, start: str | None, end: str | None) -> DataFrame:
    return between(monthly, "order_month", start, end).select(
        F.col("order_month").alias("period_month"),
        "item_category",
        F.col("order_item_rows_revenue_eur").alias("revenue_eur"),
        "units_sold",
        F.col("orders").alias("orders_with_category"),
        "promo_units_sold",
        F.col(FIRST).alias("first_customers"),
        F.col(REPEAT).alias("repeat_customers"),
        F.col("weighted_avg_selling_price_eur").alias("weighted_asp_eur"),
    )


def category_performance(monthly: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Monthly category size with growth ratios and customer mix."""
    w = _by_month("period_month")
    base = _monthly_base(monthly, start, end)

    def growth(c: str):
        return safe_divide(F.col(c) - F.lag(c).over(w), F.lag(c).over(w))

    return base.select(
        "period_month",
        "item_category",
        "revenue_eur",
        "units_sold",
        "orders_with_category",
        "weighted_asp_eur",
        safe_divide("promo_units_sold", "units_sold").alias("promo_unit_share"),
        safe_divide("repeat_customers", F.col("first_customers") + F.col("repeat_customers")).alias(
            "repeat_customer_mix_ratio"
        ),
        growth("revenue_eur").alias("revenue_mom_growth_ratio"),
        growth("units_sold").alias("units_mom_growth_ratio"),
        growth("orders_with_category").alias("orders_mom_growth_ratio"),
    ).orderBy("item_category", "period_month")


def scorecard_controls(
    monthly: DataFrame, items: DataFrame, start: str | None = None, end: str | None = None, item_end: str | None = None
) -> DataFrame:
    """Category scorecard with growth, volatility and control flags.

    `start`/`end` bound the months, `item_end` the last order date of the star product.
    """
    base = _monthly_base(monthly, start, end)
    at = F.col("period_month")
    by_category = base.groupBy("item_category").agg(
        F.sum("revenue_eur").alias("total_revenue_eur"),
        F.sum("units_sold").alias("total_units_sold"),
        F.sum("orders_with_category").alias("total_orders_with_category"),
        F.sum("promo_units_sold").alias("promo_units"),
        F.sum("first_customers").alias("first_customers"),
        F.sum("repeat_customers").alias("repeat_customers"),
        F.avg(F.col("revenue_eur").cast("double")).alias("mean_revenue"),
        F.stddev_pop(F.col("revenue_eur").cast("double")).alias("spread_revenue"),
        # values of the first and the last month without joining back to the months
        *[F.min_by(c, at).alias(f"first_{c}") for c in ("revenue_eur", "units_sold", "orders_with_category")],
        *[F.max_by(c, at).alias(f"last_{c}") for c in ("revenue_eur", "units_sold", "orders_with_category")],
    )
    products = (
        between(items, "order_date", start, item_end)
        .groupBy("item_category", "item_key")
        .agg(F.min("item_name_preferred").alias("name"), F.sum(REVENUE).alias("star_revenue"))
    )
    star = top_n_per_group(products, ["item_category"], [F.desc("star_revenue"), F.asc("item_key")], 1)

    def growth(c: str):
        return safe_divide(F.col(f"last_{c}") - F.col(f"first_{c}"), f"first_{c}")

    def flag(cond):
        return F.when(cond, 1).otherwise(0).cast("long")

    scored = by_category.join(star, "item_category", "left").select(
        "item_category",
        "total_revenue_eur",
        "total_units_sold",
        "total_orders_with_category",
        safe_divide("total_revenue_eur", "total_units_sold").alias("weighted_asp_eur"),
        safe_divide("promo_units", "total_units_sold").alias("promo_unit_share"),
        safe_divide("repeat_customers", F.col("first_customers") + F.col("repeat_customers")).alias(
            "repeat_customer_mix_ratio"
        ),
        growth("revenue_eur").alias("revenue_growth_ratio_first_to_last"),
        growth("units_sold").alias("unit_growth_ratio_first_to_last"),
        growth("orders_with_category").alias("order_growth_ratio_first_to_last"),
        safe_divide("spread_revenue", "mean_revenue").alias("revenue_cv"),
        F.col("item_key").alias("star_item_key"),
        F.col("name").alias("star_item_name"),
        F.col("star_revenue").alias("star_item_revenue_eur"),
        safe_divide("star_revenue", "total_revenue_eur").alias("star_item_revenue_share"),
    )
    # Thresholds of the four control flags.
    return (
        scored.withColumn("control_high_star_concentration_flag", flag(F.col("star_item_revenue_share") >= 0.65))
        .withColumn("control_high_revenue_volatility_flag", flag(F.col("revenue_cv") >= 0.60))
        .withColumn("control_high_promo_dependency_flag", flag(F.col("promo_unit_share") >= 0.12))
        .withColumn("control_low_repeat_mix_flag", flag(F.col("repeat_customer_mix_ratio") <= 0.95))
        .orderBy(F.desc("total_revenue_eur"), "item_category")
    )


def star_products_detail(
    items: DataFrame, start: str | None = None, end: str | None = None, n: int = 10
) -> DataFrame:
    """The n best products of every category with their share of it."""
    rows = between(items, "order_date", start, end).where(F.col("item_category").isNotNull())
    per_order = rows.groupBy("item_category", "item_key", short_key(rows, "order_sk")).agg(
        F.min("item_name_preferred").alias("name"), F.sum(REVENUE).alias("revenue"), F.sum(UNITS).alias("units")
    )
    products = per_order.groupBy("item_category", "item_key").agg(
        F.min("name").alias("item_name_preferred"),
        F.sum("revenue").alias("revenue_eur"),
        F.sum("units").alias("units_sold"),
        F.count(F.lit(1)).alias("orders_count"),
    )
    totals = rows.groupBy("item_category").agg(F.sum(REVENUE).alias("c_revenue"), F.sum(UNITS).alias("c_units"))
    order = [F.desc("revenue_eur"), F.asc("item_key")]
    best = top_n_per_group(products, ["item_category"], order, n, "revenue_rank_in_category")
    return (
        best.join(totals, "item_category")
        .select(
            "item_category",
            "item_key",
            "item_name_preferred",
            "revenue_eur",
            "units_sold",
            "orders_count",
            safe_divide("revenue_eur", "c_revenue").alias("revenue_share_in_category"),
            safe_divide("units_sold", "c_units").alias("unit_share_in_category"),
            "revenue_rank_in_category",
        )
        .orderBy("item_category", "revenue_rank_in_category")
    )
