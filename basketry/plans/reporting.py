"""Reporting marts on the order and order-item facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.config import DAYPARTS_FOUR, Settings
from basketry.functions import (
    count_where,
    daypart,
    distinct_list,
    local_time,
    month_of,
    pack_key,
    preferred_name,
    safe_divide,
    short_key,
    sum_where,
    unpack_key,
)
from basketry.operators.joins import null_safe_join, with_totals
from basketry.operators.pairs import (
    affinity_scores,
    basket_sets,
    directed_pairs,
    member_counts,
    unordered_pairs,
)
from basketry.operators.ranking import kpi_long, measure_rollup, order_grain, top_n, top_n_per_group, top_products
from basketry.session import materialize

REVENUE = "order_item_row_final_amount_gross_eur"
BASE = "order_item_row_base_amount_gross_eur"
DISCOUNT = "order_item_row_discount_amount_gross_eur"
UNITS = "units_in_order_item_row"


def promo_units() -> Column:
    return F.when(F.col("is_promo_item"), F.col(UNITS)).otherwise(F.lit(0))


def concentration(
    rows: DataFrame, by: list[str], product: str, revenue: str, nullable: bool = False
) -> DataFrame:
    """Per group: number of products, group revenue, revenue of the best and of the best three products.

    Only three candidates per group survive each task, however many products a group has. Both halves read
    the products from one shuffle, as long as the group columns are not `nullable`.
    """
    products = rows.groupBy(*by, product).agg(F.sum(revenue).alias("product_revenue"))
    size = products.groupBy(*by).agg(
        F.count(product).alias("sku_count"), F.sum("product_revenue").alias("group_revenue")
    )
    order = [F.desc("product_revenue"), F.asc_nulls_first(product)]
    best = top_n_per_group(products, by, order, 3, "place")
    top = best.groupBy(*by).agg(
        F.max(F.when(F.col("place") == 1, F.col("product_revenue"))).alias("top_sku_revenue"),
        F.sum("product_revenue").alias("top_3_revenue"),
    )
    return null_safe_join(size, top, by) if nullable else size.join(top, by, "left")


# ----------------------------------------------------------------------------------- category monthly


def category_rows(items: DataFrame) -> DataFrame:
    return items.select(
        month_of("order_date").alias("order_month"),
        F.coalesce("item_category", F.lit("Unknown")).alias("item_category"),
        "order_sk",
        "customer_sk",
        F.col(UNITS).alias("units_sold"),
        F.col(REVENUE).alias("revenue_eur"),
        F.col(BASE).alias("base_revenue_eur"),
        F.col(DISCOUNT).alias("discount_eur"),
        promo_units().alias("promo_units_sold"),
        preferred_name("Unknown Item").alias("product_name"),
    )


def order_categories(items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per order and category (null is a category), with the sums, the promotion flag and the order's context.

    The grain from which sets of categories, buyers, orders and sums of any coarser group are folded, so that the reports by
    category read the item fact once for it and once for its products.
    """
    return order_category_columns(order_category_rows(items, orders))


def order_category_columns(rows: DataFrame) -> DataFrame:
    """`order_categories` from what `order_category_rows` gives."""
    return rows.withColumns({c: unpack_key(c) for c in ("order_sk", "customer_sk")})


def order_category_rows(items: DataFrame, orders: DataFrame) -> DataFrame:
    """`order_categories` with its keys packed, as they are moved and stored."""
    per_order = items.groupBy(month_of("order_date").alias("order_month"), "item_category", *[pack_key(c).alias(c) for c in ("order_sk", "customer_sk")]).agg(
        F.sum(REVENUE).alias("revenue_eur"),
        F.sum(BASE).alias("base_revenue_eur"),
        F.sum(DISCOUNT).alias("discount_eur"),
        F.sum(UNITS).alias("units_sold"),
        F.sum(promo_units()).alias("promo_units_sold"),
        F.max("is_promo_item").alias("has_promo"),
    )
    context = orders.select(
        pack_key("order_sk").alias("order_sk"),
        F.col("is_first_order_for_customer").alias("is_first"),
        F.col("delivery_distance_line_meters").alias("distance"),
        F.col("total_units_in_order").alias("order_units"),
    )
    return per_order.join(context, "order_sk", "left")


def no_context(items: DataFrame) -> DataFrame:
    """An order table without rows, for reports that need no context of the orders."""
    schema = "order_sk string, is_first_order_for_customer boolean, delivery_distance_line_meters long, total_units_in_order long"
    return items.sparkSession.createDataFrame([], schema)


def named_order_categories(order_rows: DataFrame) -> DataFrame:
    """Order categories with the missing one under its name; it meets one of that name, if there is one."""
    name = F.coalesce("item_category", F.lit("Unknown"))
    context = ["is_first", "distance", "order_units"]
    return (
        order_rows.withColumn("item_category", name)
        .groupBy(*KEYS, short_key(order_rows, "order_sk"), short_key(order_rows, "customer_sk"))
        .agg(*[F.sum(c).alias(c) for c in SUMS], *[F.first(c).alias(c) for c in context])
    )


KEYS = ["order_month", "item_category"]
SUMS = ["revenue_eur", "base_revenue_eur", "discount_eur", "units_sold", "promo_units_sold"]


def monthly_totals(rows: DataFrame) -> DataFrame:
    """Revenue, orders and customers per month."""
    return measure_rollup(rows, ["order_month"], {"total_revenue_eur": "revenue_eur"}).select(
        "order_month",
        "total_revenue_eur",
        F.col("orders").alias("total_orders"),
        F.col("customers").alias("total_customers"),
    )


def repeat_rate(rows: DataFrame) -> DataFrame:
    """Share of customers with more than one order in the category and month."""
    rolled = measure_rollup(rows, KEYS, {})
    return rolled.select(*KEYS, safe_divide("repeat_customers", "customers").alias("repeat_customer_rate"))


def monthly_concentration(rows: DataFrame) -> DataFrame:
    return concentration(rows, KEYS, "product_name", "revenue_eur").select(
        *KEYS,
        "sku_count",
        safe_divide("top_sku_revenue", "group_revenue").alias("top_sku_share"),
        safe_divide("top_3_revenue", "group_revenue").alias("top_3_share"),
    )


def monthly_baskets(rows: DataFrame) -> DataFrame:
    """Orders per month and distinct set of categories."""
    return basket_sets(rows, "order_sk", "item_category", ["order_month"])


def top_attached(baskets: DataFrame) -> DataFrame:
    """Per category and month the category most often bought in the same order, with its attach rate."""
    by = ["order_month"]
    base = member_counts(baskets, by).withColumnRenamed("a", "item_category")
    pairs = directed_pairs(baskets, by).withColumnsRenamed({"a": "item_category", "b": "top_attached_category"})
    rated = pairs.join(base, KEYS).withColumn("cross_sell_attach_rate", safe_divide("pair_orders", "orders"))
    order = [F.desc("cross_sell_attach_rate"), F.desc("pair_orders"), F.asc("top_attached_category")]
    return top_n_per_group(rated, KEYS, order, 1, "place").select(
        *KEYS, "top_attached_category", "cross_sell_attach_rate"
    )


FIRST = "distinct_customers_whose_first_order_included_category_in_month"
REPEAT = "distinct_customers_with_repeat_orders_including_category_in_month"


def category_buyers(per_order: DataFrame) -> DataFrame:
    """Named order categories folded to (month, category, customer)."""
    first = F.col("is_first")
    return per_order.groupBy(*KEYS, short_key(per_order, "customer_sk")).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.count("order_sk").alias("orders"),
        F.max(first).alias("had_first"),
        F.max(~first).alias("had_repeat"),
        *[F.sum(c).alias(c) for c in ("distance", "order_units")],
        *[F.count(c).alias(f"{c}_n") for c in ("distance", "order_units")],
    )


def category_core(per_customer: DataFrame) -> DataFrame:
    """Per category and month: sums, distinct orders and customers, and the context of those orders."""
    return per_customer.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in (*SUMS, "orders")],
        F.count("customer_sk").alias("customers"),
        count_where(F.col("orders") > 1).alias("repeat_customers"),
        count_where(F.col("had_first")).alias(FIRST),
        count_where(F.col("had_repeat")).alias(REPEAT),
        safe_divide(F.sum("distance"), F.sum("distance_n")).alias("avg_delivery_distance_meters"),
        safe_divide(F.sum("order_units"), F.sum("order_units_n")).alias("avg_order_units_for_orders_with_category"),
    )


def order_context(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Per category and month: first-time and repeat customers, mean distance and mean order size."""
    return category_core(category_buyers(named_order_categories(order_categories(items, orders)))).select(
        *KEYS, FIRST, REPEAT, "avg_delivery_distance_meters", "avg_order_units_for_orders_with_category"
    )


def category_monthly(items: DataFrame, orders: DataFrame, order_rows: DataFrame | None = None) -> DataFrame:
    """Category by month: revenue, shares, penetration, prices, repeat rate, concentration, attach rate.

    `order_rows` is a stored `order_categories`; without it one is stored here. Customers of a month are folded from the customers of
    its categories, orders of a month from the sets of categories.
    """
    if order_rows is None:
        order_rows = materialize(order_categories(items, orders), "order-categories")
    per_order = named_order_categories(order_rows)
    baskets = basket_sets(order_rows.withColumn("item_category", F.coalesce("item_category", F.lit("Unknown"))), "order_sk", "item_category", ["order_month"])
    per_customer = category_buyers(per_order)
    buyers = per_customer.groupBy("order_month", "customer_sk").agg(F.count(F.lit(1)).alias("categories"))
    month_buyers = buyers.groupBy("order_month").agg(F.count("customer_sk").alias("total_customers"))
    month_orders = baskets.groupBy("order_month").agg(F.sum("baskets").alias("total_orders"))
    # the core has one row per category and month, so its window is as long as the list of categories
    whole_month = W.partitionBy("order_month")
    core = category_core(per_customer).withColumn("total_revenue_eur", F.sum("revenue_eur").over(whole_month))
    joined = (
        core.join(month_orders, "order_month")
        .join(month_buyers, "order_month")
        .join(monthly_concentration(category_rows(items)), KEYS, "left")
        .join(top_attached(baskets), KEYS, "left")
    )
    zero = F.lit(0.0)
    asp = safe_divide("revenue_eur", "units_sold")
    return joined.select(
        *KEYS,
        "revenue_eur",
        "base_revenue_eur",
        "discount_eur",
        safe_divide("discount_eur", "base_revenue_eur").alias("discount_rate"),
        "units_sold",
        "orders",
        "customers",
        safe_divide("revenue_eur", "total_revenue_eur").alias("revenue_share"),
        safe_divide("orders", "total_orders").alias("order_penetration"),
        safe_divide("customers", "total_customers").alias("customer_penetration"),
        asp.alias("asp_eur"),
        safe_divide("revenue_eur", "orders").alias("revenue_per_order_eur"),
        safe_divide("units_sold", "orders").alias("units_per_order"),
        safe_divide("orders", "customers").alias("orders_per_customer"),
        F.coalesce(safe_divide("repeat_customers", "customers"), zero).alias("repeat_customer_rate"),
        "sku_count",
        F.coalesce("top_sku_share", zero).alias("top_sku_share"),
        F.coalesce("top_3_share", zero).alias("top_3_share"),
        "top_attached_category",
        F.coalesce("cross_sell_attach_rate", zero).alias("cross_sell_attach_rate"),
        F.col("revenue_eur").alias("order_item_rows_revenue_eur"),
        F.col("discount_eur").alias("order_item_rows_discount_eur"),
        asp.alias("weighted_avg_selling_price_eur"),
        F.col("customers").alias("distinct_customers_in_month"),
        FIRST,
        REPEAT,
        "promo_units_sold",
        "avg_order_units_for_orders_with_category",
        "avg_delivery_distance_meters",
    )


# Metric labels of the long table and the columns they show.
KPI_LABELS = {
    "Revenue EUR": "revenue_eur",
    "Base Revenue EUR": "base_revenue_eur",
    "Discount EUR": "discount_eur",
    "Discount Rate": "discount_rate",
    "Units": "units_sold",
    "Orders": "orders",
    "Customers": "customers",
    "Revenue Share": "revenue_share",
    "Order Penetration": "order_penetration",
    "Customer Penetration": "customer_penetration",
    "ASP EUR": "asp_eur",
    "Revenue Per Order EUR": "revenue_per_order_eur",
    "Units Per Order": "units_per_order",
    "Orders Per Customer": "orders_per_customer",
    "Repeat Customer Rate": "repeat_customer_rate",
    "SKU Count": "sku_count",
    "Top SKU Share": "top_sku_share",
    "Top 3 Share": "top_3_share",
    "Cross-sell Attach Rate": "cross_sell_attach_rate",
}


def category_kpi_long(monthly: DataFrame) -> DataFrame:
    return kpi_long(monthly, ["order_month", "item_category"], KPI_LABELS, "metric_name", "metric_value")


def category_kpi_mom(long: DataFrame) -> DataFrame:
    """Change of every KPI against the previous month in which the category existed."""
    # one row per month: a group is as long as the calendar
    w = W.partitionBy("item_category", "metric_name").orderBy("order_month")
    lagged = long.withColumn("previous_month_metric_value", F.lag("metric_value").over(w))
    change = F.col("metric_value") - F.col("previous_month_metric_value")
    return lagged.withColumn("mom_absolute_change", change).withColumn(
        "mom_percentage_change", safe_divide(change, "previous_month_metric_value")
    )


# ----------------------------------------------------------------------------------- overall scorecard


def category_scorecard(items: DataFrame, order_rows: DataFrame | None = None) -> DataFrame:
    """One row per category over all time; a missing category is its own row.

    `order_rows` is a stored `order_categories`: sums, orders and customers of categories and of the whole are folded from it, and
    the items are read for the products only.
    """
    if order_rows is None:
        order_rows = materialize(order_categories(items, no_context(items)), "order-categories")
    rows = order_rows.select(
        "order_sk",
        "customer_sk",
        F.col("item_category").alias("category"),
        F.col("units_sold").alias("units"),
        F.col("revenue_eur").alias("revenue"),
        F.col("base_revenue_eur").alias("base"),
        F.col("discount_eur").alias("discount"),
        F.col("has_promo").alias("is_promo_item"),
    )
    core = measure_rollup(
        rows,
        ["category"],
        {"revenue": "revenue", "base": "base", "discount": "discount", "units": "units"},
        order_flags={"promo_orders": F.col("is_promo_item")},
    )
    totals = measure_rollup(rows, [], {"total_revenue_eur": "revenue"}).select(
        "total_revenue_eur", F.col("orders").alias("total_orders"), F.col("customers").alias("total_customers")
    )
    products = items.select(preferred_name().alias("product_name"), F.col("item_category").alias("category"), F.col(REVENUE).alias("revenue"))
    spread = concentration(products, ["category"], "product_name", "revenue", nullable=True).select(
        "category", F.col("top_sku_revenue").alias("top_sku_revenue_eur"), F.col("top_3_revenue").alias("top_3_revenue_eur")
    )
    joined = null_safe_join(with_totals(core, totals), spread, ["category"])

    def pct(a: str, b: str, digits: int) -> Column:
        return F.round(100 * safe_divide(a, b), digits)

    return joined.select(
        "category",
        F.round("revenue", 2).alias("revenue_eur"),
        pct("revenue", "total_revenue_eur", 2).alias("share_pct"),
        "units",
        "orders",
        "customers",
        pct("orders", "total_orders", 1).alias("order_pen_pct"),
        pct("customers", "total_customers", 1).alias("customer_pen_pct"),
        F.round(safe_divide("revenue", "units"), 2).alias("asp_eur"),
        pct("discount", "base", 2).alias("disc_pct"),
        pct("promo_orders", "orders", 2).alias("promo_pct"),
        F.round(safe_divide("revenue", "orders"), 2).alias("rev_per_order_eur"),
        F.round(safe_divide("orders", "customers"), 2).alias("orders_per_customer"),
        pct("repeat_customers", "customers", 1).alias("repeat_pct"),
        pct("top_sku_revenue_eur", "revenue", 1).alias("top_sku_pct"),
        pct("top_3_revenue_eur", "revenue", 1).alias("top_3_pct"),
        "total_revenue_eur",
        "total_orders",
        "total_customers",
        "promo_orders",
        "repeat_customers",
        "top_sku_revenue_eur",
        "top_3_revenue_eur",
    ).orderBy(F.desc("revenue_eur"), F.asc_nulls_first("category"))


# --------------------------------------------------------------------------------------- star products


def star_products(items: DataFrame, n: int = 10) -> DataFrame:
    """The products with the highest revenue; the first two are marked as heroes."""
    rows = items.select(
        "order_sk",
        "customer_sk",
        preferred_name().alias("product_name"),
        F.nullif(F.trim("brand_name"), F.lit("")).alias("brand"),
        F.col(UNITS).alias("units"),
        F.col(REVENUE).alias("revenue"),
        F.col(BASE).alias("base"),
        F.col(DISCOUNT).alias("discount"),
    )
    # the products are chosen by their sums alone; only rows of the chosen ones are folded to orders and customers
    theirs = null_safe_join(rows, F.broadcast(top_products(rows, "revenue", n)), ["product_name"], "left_semi")
    products = measure_rollup(
        theirs,
        ["product_name"],
        {"revenue": "revenue", "units": "units", "base": "base", "discount": "discount"},
    )
    best = top_n(products, [F.desc("revenue"), F.asc_nulls_first("product_name")], n, "rank_no")
    # one brand per product; the smallest name where several occur
    brands = theirs.groupBy("product_name").agg(F.min("brand").alias("brand"))
    named = null_safe_join(best, brands, ["product_name"])
    total = rows.agg(F.sum("revenue").alias("total_revenue"))
    return (
        with_totals(named, total)
        .select(
            "rank_no",
            "product_name",
            F.coalesce("brand", F.lit("Unknown")).alias("brand_name"),
            F.round("revenue", 2).alias("revenue_eur"),
            F.round(100 * safe_divide("revenue", "total_revenue"), 2).alias("share_pct"),
            "units",
            "orders",
            "customers",
            F.round(safe_divide("revenue", "units"), 2).alias("asp_eur"),
            F.round(100 * safe_divide("discount", "base"), 2).alias("disc_pct"),
            F.when(F.col("rank_no") <= 2, F.lit("HERO")).alias("hero_flag"),
        )
        .orderBy("rank_no")
    )


# -------------------------------------------------------------------------------------------- dayparts


def category_daypart_monthly(items: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Revenue and units by category, month, local weekday and hour.

    The item row carries its order's time, so the order fact is not joined.
    """
    local = local_time("order_ts_utc", cfg.business_zone)
    rows = items.where(F.col("item_category").isNotNull()).select(
        month_of("order_date").alias("order_month"),
        "item_category",
        F.dayofweek(local).cast("long").alias("day_of_week_berlin_num"),
        F.date_format(local, "EEEE").alias("day_of_week_berlin"),
        F.hour(local).cast("long").alias("order_hour_berlin"),
        F.col(REVENUE).alias("revenue"),
        F.col(UNITS).alias("units"),
    )
    keys = ["order_month", "item_category", "day_of_week_berlin_num", "day_of_week_berlin", "order_hour_berlin"]
    rolled = rows.groupBy(*keys).agg(F.sum("revenue").alias("revenue_eur"), F.sum("units").alias("units_sold"))
    return rolled.select(
        *keys, daypart("order_hour_berlin", DAYPARTS_FOUR).alias("daypart_berlin"), "revenue_eur", "units_sold"
    ).orderBy("order_month", "item_category", "day_of_week_berlin_num", "order_hour_berlin")


# ------------------------------------------------------------------------------------------- affinity

PAIR_METRICS = (
    "support",
    "expected_support_independent",
    "expected_pair_orders_independent",
    "pair_orders_vs_expected_delta",
    "pair_orders_vs_expected_pct",
    "confidence_a_to_b",
    "confidence_b_to_a",
    "lift",
)


def category_pairs(items: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Affinity of category pairs over all orders that contain a known category."""
    known = items.where(F.col("item_category").isNotNull())
    sets = basket_sets(known, "order_sk", "item_category")
    total = sets.agg(F.sum("baskets").alias("total_orders"))
    scored = affinity_scores(unordered_pairs(sets), member_counts(sets), total, cfg)
    return scored.select(
        F.col("a").alias("category_a"),
        F.col("b").alias("category_b"),
        "pair_orders",
        F.col("a_orders").alias("category_a_orders"),
        F.col("b_orders").alias("category_b_orders"),
        "total_orders",
        F.col("a_order_penetration").alias("category_a_order_penetration"),
        F.col("b_order_penetration").alias("category_b_order_penetration"),
        *PAIR_METRICS,
        "actionability_bucket",
        "actionability_rank",
    ).orderBy("actionability_rank", F.desc("lift"), F.desc("pair_orders"), "category_a", "category_b")


def pair_pattern(cfg: Settings) -> Column:
    """Label of a product pair by the categories of its two products."""
    a, b = F.col("category_a"), F.col("category_b")
    snack, dip, sweet = cfg.snack_category, cfg.dip_category, list(cfg.sweet_categories)
    chip_dip = ((a == snack) & (b == dip)) | ((a == dip) & (b == snack))
    return (
        F.when((a == snack) & (b == snack), "Chip + Chip")
        .when(chip_dip, "Chip + Dip")
        .when(a.isin(sweet) & b.isin(sweet), "Choc + Choc")
        .otherwise("Cross-category")
    )


def product_pairs(items: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Affinity of pairs among the top products by revenue that share enough orders."""
    named = items.select("order_sk", preferred_name().alias("product_name"), "item_category", F.col(REVENUE).alias("revenue"))
    with_name = named.where(F.col("product_name").isNotNull())
    by_category = with_name.groupBy("product_name", "item_category").agg(F.sum("revenue").alias("revenue"))
    by_product = by_category.groupBy("product_name").agg(F.sum("revenue").alias("revenue"))
    top = top_n(by_product, [F.desc("revenue"), F.asc("product_name")], cfg.top_products).select("product_name")
    # the category a product earns most in; the list of top products is bounded by its limit
    main = top_n_per_group(
        by_category.where(F.col("item_category").isNotNull()).join(F.broadcast(top), "product_name", "left_semi"),
        ["product_name"], [F.desc("revenue"), F.asc("item_category")], 1, "place",
    ).select("product_name", "item_category")
    chosen = with_name.join(F.broadcast(top), "product_name", "left_semi")
    sets = basket_sets(chosen, "order_sk", "product_name")
    total = items.select(short_key(items, "order_sk")).distinct().agg(F.count(F.lit(1)).alias("total_orders"))
    pairs = unordered_pairs(sets).where(F.col("pair_orders") >= cfg.min_pair_orders)
    scored = affinity_scores(pairs, member_counts(sets), total, cfg)
    labelled = scored.join(
        main.withColumnsRenamed({"product_name": "a", "item_category": "category_a"}), "a", "left"
    ).join(main.withColumnsRenamed({"product_name": "b", "item_category": "category_b"}), "b", "left")
    return labelled.select(
        F.col("a").alias("product_a"),
        F.col("b").alias("product_b"),
        "pair_orders",
        F.col("a_orders").alias("product_a_orders"),
        F.col("b_orders").alias("product_b_orders"),
        "total_orders",
        F.col("a_order_penetration").alias("product_a_order_penetration"),
        F.col("b_order_penetration").alias("product_b_order_penetration"),
        *PAIR_METRICS,
        "category_a",
        "category_b",
        pair_pattern(cfg).alias("pattern"),
        "actionability_bucket",
        "actionability_rank",
    ).orderBy("actionability_rank", F.desc("lift"), F.desc("pair_orders"), "product_a", "product_b")


# ------------------------------------------------------------------------------------ customers, items


def customer_promo_behavior(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Per customer: orders, units and value with and without promotion, and the nature of the first order."""
    promo = F.col("is_promo_item")
    mix = items.groupBy(*[pack_key(c).alias(c) for c in ("order_sk", "customer_sk")]).agg(
        sum_where(promo, UNITS).alias("promo_units"),
        sum_where(~promo, UNITS).alias("other_units"),
        F.sum(F.when(promo, F.col(REVENUE)).otherwise(F.lit(0).cast("decimal(18,4)"))).alias("promo_value"),
        F.sum(F.when(~promo, F.col(REVENUE)).otherwise(F.lit(0).cast("decimal(18,4)"))).alias("other_value"),
    )
    facts = orders.select(pack_key("order_sk").alias("order_sk"), "customer_key", "order_ts_utc", "order_ts_berlin", "is_first_order_for_customer")
    any_promo, no_other = F.col("promo_units") > 0, F.col("other_units") == 0
    first = F.col("is_first_order_for_customer")
    rolled = (
        mix.join(facts, "order_sk")
        .groupBy("customer_sk")
        .agg(
            F.min("customer_key").alias("customer_key"),
            F.min("order_ts_utc").alias("first_order_ts_utc"),
            F.min("order_ts_berlin").alias("first_order_ts_berlin"),
            F.count(F.lit(1)).alias("lifetime_orders"),
            count_where(any_promo).alias("orders_with_any_promo_units"),
            count_where(F.col("promo_units") == 0).alias("orders_with_no_promo_units"),
            F.sum("promo_units").alias("promo_units_purchased"),
            F.sum("other_units").alias("non_promo_units_purchased"),
            F.sum("promo_value").alias("promo_value_eur"),
            F.sum("other_value").alias("non_promo_value_eur"),
            F.max(first & any_promo).alias("first_order_had_any_promo_units"),
            F.max(first & any_promo & no_other).alias("first_order_had_only_promo_units"),
        )
    )
    only = (F.col("promo_units_purchased") > 0) & (F.col("non_promo_units_purchased") == 0)
    return rolled.select(
        unpack_key("customer_sk").alias("customer_sk"),
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
        only.alias("promo_only_customer_flag"),
        "lifetime_orders",
    )


def items_in_several_categories(items: DataFrame) -> DataFrame:
    """Items that were sold under more than one category."""
    per_item = items.groupBy(
        "item_key",
        preferred_name("Unknown Item").alias("product_name"),
        F.coalesce("item_category", F.lit("Unknown")).alias("item_category"),
    ).agg(
        F.min("order_date").alias("first_seen"), F.max("order_date").alias("last_seen"), F.count(F.lit(1)).alias("n")
    )
    return (
        per_item.groupBy("item_key")
        .agg(
            F.min("product_name").alias("product_name"),
            F.count_distinct("item_category").alias("distinct_category_count"),
            distinct_list("item_category").alias("categories_seen"),
            F.min("first_seen").alias("first_seen_order_date"),
            F.max("last_seen").alias("last_seen_order_date"),
            F.sum("n").alias("total_rows"),
        )
        .where(F.col("distinct_category_count") > 1)
        .orderBy(F.desc("distinct_category_count"), F.desc("total_rows"), "item_key")
    )
