"""Datasets behind the dashboards: chart tables and one-row insights.

Every insight has the columns insight_title, insight_value, insight_comment. Where a ranking could tie, a
name decides, so results are stable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.config import DAYPARTS_FIVE, NIGHT, Settings
from basketry.functions import (
    count_where,
    daypart,
    distinct_list,
    local_time,
    month_of,
    plain_number,
    preferred_name,
    quantile,
    safe_divide,
    short_key,
    sum_where,
)
from basketry.operators.joins import null_safe_join, with_totals
from basketry.operators.pairs import basket_sets, directed_pairs, member_counts
from basketry.operators.ranking import kpi_long, measure_rollup, top_n, top_n_per_group, top_products
from basketry.plans.answers import between
from basketry.plans.reporting import BASE, DISCOUNT, REVENUE, UNITS, concentration

MONTH = "period_month"


def _monthly(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH, month_of("order_date"))


def _percent(ratio: Column) -> Column:
    return F.concat(plain_number(ratio * 100, 2), F.lit("%"))


def insight(row: DataFrame, title: str, value: Column, comment: Column | str) -> DataFrame:
    note = F.lit(comment) if isinstance(comment, str) else comment
    return row.select(F.lit(title).alias("insight_title"), value.alias("insight_value"), note.alias("insight_comment"))


def _latest(monthly: DataFrame) -> DataFrame:
    return top_n(monthly, [F.desc(MONTH)], 1)


def latest_month(fact: DataFrame) -> DataFrame:
    """Rows of the latest month only: plain bounds on the date, so a fact partitioned by date reads one month of it."""
    latest = fact.select(F.max(month_of("order_date"))).scalar()
    return fact.where(F.col("order_date").between(latest, F.last_day(latest)))


# ------------------------------------------------------------------------------- monthly store charts


def latest_month_headlines(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Top category, order count and promotion share of the latest month, one row each."""
    latest = orders.select(F.max(month_of("order_date"))).scalar()
    this_month = F.col("order_date").between(latest, F.last_day(latest))
    by_category = items.where(this_month).groupBy("item_category").agg(F.sum(UNITS).alias("units"))
    top = top_n(by_category, [F.desc("units"), F.asc_nulls_first("item_category")], 1)
    month = orders.where(this_month).agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("has_any_promo_units_in_order")).alias("promo")
    )

    def row(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("insight_name"), value.alias("insight_value"))

    share = plain_number(F.coalesce(safe_divide("promo", "n"), F.lit(0.0)) * 100, 2)
    return reduce(
        DataFrame.unionByName,
        [
            row(
                top.agg(F.max("item_category").alias("c")), "Top category by units (latest month)",
                F.coalesce("c", F.lit("n/a")),
            ),
            row(month, "Orders in latest month", F.col("n").cast("string")),
            row(month, "Promo order share (latest month)", share),
        ],
    )


def service_area_monthly(orders: DataFrame) -> DataFrame:
    d = "delivery_distance_line_meters"
    return (
        _monthly(orders)
        .groupBy(MONTH)
        .agg(
            F.count(F.lit(1)).alias("orders_count"),
            F.round(F.avg(d), 2).alias("avg_delivery_distance_m"),
            quantile(d, 50, (50, 90)).alias("p50_delivery_distance_m"),
            quantile(d, 90, (50, 90)).alias("p90_delivery_distance_m"),
        )
        .orderBy(MONTH)
    )


def service_area_insight(orders: DataFrame) -> DataFrame:
    monthly = _monthly(latest_month(orders)).groupBy(MONTH).agg(F.avg("delivery_distance_line_meters").alias("d"))
    value = F.concat(F.lit("latest avg distance: "), plain_number("d", 2), F.lit(" m"))
    return insight(_latest(monthly), "Service area trend", value, "based on latest month")


def items_prices_monthly(items: DataFrame) -> DataFrame:
    rolled = _monthly(items).groupBy(MONTH, "item_category").agg(
        F.sum(UNITS).alias("units_sold"), F.sum(REVENUE).alias("revenue")
    )
    price = safe_divide("revenue", "units_sold").alias("weighted_avg_unit_selling_price_eur")
    return rolled.select(MONTH, "item_category", "units_sold", price).orderBy(
        MONTH, F.desc("units_sold"), "item_category"
    )


def items_prices_insight(items: DataFrame) -> DataFrame:
    monthly = _monthly(latest_month(items)).groupBy(MONTH, "item_category").agg(F.sum(UNITS).alias("units"))
    order = [F.desc(MONTH), F.desc("units"), F.asc_nulls_first("item_category")]
    comment = F.concat(F.lit("units="), F.col("units").cast("string"))
    return insight(
        top_n(monthly, order, 1), "Top category by units (latest month)", F.col("item_category"), comment
    )


def promo_uptake_monthly(orders: DataFrame, items: DataFrame) -> DataFrame:
    units = _monthly(items).groupBy(MONTH).agg(
        sum_where(F.col("is_promo_item"), UNITS).alias("promo_units"), F.sum(UNITS).alias("total_units")
    )
    counts = _monthly(orders).groupBy(MONTH).agg(
        count_where(F.col("has_any_promo_units_in_order")).alias("orders_with_any_promo"),
        F.count(F.lit(1)).alias("total_orders"),
    )
    return (
        units.join(counts, MONTH)
        .select(
            MONTH,
            "promo_units",
            "total_units",
            safe_divide("promo_units", "total_units").alias("promo_unit_share"),
            "orders_with_any_promo",
            "total_orders",
            safe_divide("orders_with_any_promo", "total_orders").alias("promo_order_share"),
        )
        .orderBy(MONTH)
    )


def promo_uptake_insight(items: DataFrame) -> DataFrame:
    units = _monthly(latest_month(items)).groupBy(MONTH).agg(
        sum_where(F.col("is_promo_item"), UNITS).alias("promo"), F.sum(UNITS).alias("total")
    )
    return insight(
        _latest(units), "Promo unit share (latest month)", _percent(safe_divide("promo", "total")),
        "share of units bought on promo",
    )


def repeat_orders_monthly(orders: DataFrame) -> DataFrame:
    first = F.col("is_first_order_for_customer")
    return (
        _monthly(orders)
        .groupBy(MONTH)
        .agg(
            count_where(first).alias("first_orders"),
            count_where(~first).alias("repeat_orders"),
            safe_divide(count_where(~first), F.count(F.lit(1))).alias("repeat_order_share"),
        )
        .orderBy(MONTH)
    )


def repeat_orders_insight(orders: DataFrame) -> DataFrame:
    latest = _latest(repeat_orders_monthly(latest_month(orders)))
    return insight(
        latest, "Repeat order share (latest month)", _percent(F.col("repeat_order_share")), "customer return signal"
    )


def fees_monthly(orders: DataFrame) -> DataFrame:
    rolled = _monthly(orders).groupBy(MONTH).agg(
        F.sum("total_basket_value_eur").alias("basket_value_eur"),
        F.sum("service_fee_eur").alias("service_fee_eur"),
        F.sum("courier_base_fee_eur").alias("courier_base_fee_eur"),
    )
    return (
        rolled.withColumn("service_fee_to_basket_ratio", safe_divide("service_fee_eur", "basket_value_eur"))
        .withColumn("courier_fee_to_basket_ratio", safe_divide("courier_base_fee_eur", "basket_value_eur"))
        .orderBy(MONTH)
    )


def fees_insight(orders: DataFrame) -> DataFrame:
    return insight(
        _latest(fees_monthly(latest_month(orders))), "Service fee / basket (latest month)",
        _percent(F.col("service_fee_to_basket_ratio")), "pricing pressure indicator",
    )


def revenue_monthly(orders: DataFrame) -> DataFrame:
    return (
        _monthly(orders)
        .groupBy(MONTH)
        .agg(
            F.sum("total_customer_paid_eur").alias("customer_paid_total_eur"),
            F.sum("total_basket_value_eur").alias("basket_value_eur"),
            F.sum("service_fee_eur").alias("service_fee_eur"),
            F.sum("courier_base_fee_eur").alias("courier_base_fee_eur"),
        )
        .orderBy(MONTH)
    )


def revenue_insight(orders: DataFrame) -> DataFrame:
    latest = _latest(revenue_monthly(latest_month(orders)))
    return insight(latest, "Customer paid total (latest month)", plain_number("customer_paid_total_eur", 2), "EUR")


def courier_monthly(orders: DataFrame) -> DataFrame:
    fee = "courier_base_fee_eur"
    return (
        _monthly(orders)
        .groupBy(MONTH)
        .agg(
            F.sum(fee).alias("total_courier_cost_eur"),
            safe_divide(F.sum(fee), F.count(fee)).alias("avg_courier_cost_per_order_eur"),
        )
        .orderBy(MONTH)
    )


def courier_insight(orders: DataFrame) -> DataFrame:
    return insight(
        _latest(courier_monthly(latest_month(orders))), "Avg courier cost per order (latest month)",
        plain_number("avg_courier_cost_per_order_eur", 2), "EUR per order",
    )


# ------------------------------------------------------------------------------------ category charts


def category_growth(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        F.col("order_month").alias(MONTH),
        "item_category",
        F.col("order_item_rows_revenue_eur").alias("revenue_eur"),
        "units_sold",
        "weighted_avg_selling_price_eur",
    ).orderBy(MONTH, F.desc("revenue_eur"), "item_category")


def category_growth_insight(monthly: DataFrame) -> DataFrame:
    """Names of the three best categories of the latest month."""
    latest = monthly.select(F.max("order_month")).scalar()
    now = monthly.where(F.col("order_month") == latest)
    ranked = top_n(now, [F.desc("order_item_rows_revenue_eur"), F.asc("item_category")], 3, "place")
    names = [
        F.coalesce(F.max(F.when(F.col("place") == i, F.col("item_category"))), F.lit("n/a")).alias(f"n{i}")
        for i in (1, 2, 3)
    ]
    return insight(
        ranked.agg(*names), "Top categories (latest month)", F.concat_ws(", ", "n1", "n2", "n3"),
        "Updates automatically after each refresh",
    )


def stars_per_category(items: DataFrame, n: int = 10) -> DataFrame:
    products = items.groupBy("item_category", "item_key", "item_name_preferred").agg(
        F.sum(REVENUE).alias("revenue_eur"), F.sum(UNITS).alias("units_sold")
    )
    order = [F.desc("revenue_eur"), F.asc("item_key"), F.asc_nulls_first("item_name_preferred")]
    return top_n_per_group(products, ["item_category"], order, n, "category_rank").orderBy(
        F.asc_nulls_first("item_category"), "category_rank"
    )


def stars_insight(items: DataFrame) -> DataFrame:
    products = items.groupBy("item_category", "item_name_preferred").agg(F.sum(REVENUE).alias("revenue"))
    # the best product of the best category is the best product of all
    order = [F.desc("revenue"), F.asc_nulls_first("item_category"), F.asc_nulls_first("item_name_preferred")]
    return insight(
        top_n(products, order, 1), "Top product per category (sample)",
        F.concat("item_category", F.lit(": "), "item_name_preferred"), plain_number("revenue", 2),
    )


def declining_monthly(monthly: DataFrame) -> DataFrame:
    w = W.partitionBy("item_category").orderBy("order_month")
    lagged = monthly.withColumn("prev_revenue_eur", F.lag("order_item_rows_revenue_eur").over(w))
    change = F.col("order_item_rows_revenue_eur") - F.col("prev_revenue_eur")
    return (
        lagged.where(change < 0)
        .select(
            F.col("order_month").alias(MONTH),
            "item_category",
            F.col("order_item_rows_revenue_eur").alias("revenue_eur"),
            "prev_revenue_eur",
            change.alias("revenue_mom_change_eur"),
            "units_sold",
        )
        .orderBy(F.desc(MONTH), "revenue_mom_change_eur", "item_category")
    )


def declining_insight(monthly: DataFrame) -> DataFrame:
    order = [F.asc("revenue_mom_change_eur"), F.asc(MONTH), F.asc("item_category")]
    worst = top_n(declining_monthly(monthly), order, 1)
    value = F.concat("item_category", F.lit(" @ "), F.col(MONTH).cast("string"))
    comment = F.concat(F.lit("MoM change EUR: "), plain_number("revenue_mom_change_eur", 2))
    return insight(worst, "Biggest declining category", value, comment)


def strongest_pairs(pairs: DataFrame, n: int = 200) -> DataFrame:
    named = pairs.select(
        F.concat("product_a", F.lit(" + "), "product_b").alias("item_pair"),
        "pair_orders",
        "support",
        "confidence_a_to_b",
        "confidence_b_to_a",
        "lift",
    )
    return top_n(named, [F.desc("lift"), F.desc("pair_orders"), F.asc("item_pair")], n)


def strongest_pair_insight(pairs: DataFrame) -> DataFrame:
    comment = F.concat(
        F.lit("lift="), plain_number("lift", 3), F.lit(", orders="), F.col("pair_orders").cast("string")
    )
    return insight(strongest_pairs(pairs, 1), "Strongest pair (by lift)", F.col("item_pair"), comment)


def _daypart_units(items: DataFrame, cfg: Settings) -> DataFrame:
    hour = F.hour(local_time("order_ts_utc", cfg.business_zone))
    rows = items.select(daypart(hour, DAYPARTS_FIVE).alias("daypart"), "item_category", F.col(UNITS).alias("units"))
    return rows.groupBy("daypart", "item_category").agg(F.sum("units").alias("units_sold"))


def daypart_categories(items: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Units by five dayparts and category, dayparts in day order."""
    labels = [label for _, _, label in DAYPARTS_FIVE] + [NIGHT]
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("daypart"))
    return _daypart_units(items, cfg).orderBy(position, F.desc("units_sold"), F.asc_nulls_first("item_category"))


def daypart_insight(items: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    order = [F.desc("units_sold"), F.asc("daypart"), F.asc_nulls_first("item_category")]
    comment = F.concat(
        F.lit("units="), F.col("units_sold").cast("string"),
        F.lit("; calc=SUM(units_in_order_item_row) by Berlin daypart + category"),
    )
    return insight(
        top_n(_daypart_units(items, cfg), order, 1), "Top daypart-category by units",
        F.concat("daypart", F.lit(": "), "item_category"), comment,
    )


def first_order_segments(behavior: DataFrame) -> DataFrame:
    """Customers by the nature of their first order; one scan, three rows."""
    n = behavior.agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("first_order_had_any_promo_units")).alias("any"),
        count_where(F.col("first_order_had_only_promo_units")).alias("only"),
    )
    return n.select(
        F.col("any").alias("First order had any promo"),
        F.col("only").alias("First order had only promo"),
        (F.col("n") - F.col("any")).alias("No promo on first order"),
    ).unpivot(
        [], ["First order had any promo", "First order had only promo", "No promo on first order"],
        "segment", "customers",
    )


def first_order_insight(behavior: DataFrame) -> DataFrame:
    n = behavior.agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("first_order_had_any_promo_units")).alias("any"),
        count_where(F.col("first_order_had_only_promo_units")).alias("only"),
    )
    comment = F.concat(F.lit("Only-promo first orders: "), _percent(safe_divide("only", "n")))
    return insight(n, "Promo-acquired first orders", _percent(safe_divide("any", "n")), comment)


# ----------------------------------------------------------------------------------- category deep dive


def deep_dive_rows(
    items: DataFrame, start: str | None = None, end: str | None = None, cfg: Settings = Settings()
) -> DataFrame:
    """Order items of a period with product name, category and the category after remapping by name."""
    rows = between(items, "order_date", start, end).select(
        "order_date",
        "order_sk",
        "customer_sk",
        "item_key",
        preferred_name("Unknown Item").alias("product_name"),
        F.coalesce("item_category", F.lit("Unknown")).alias("item_category"),
        F.col(UNITS).alias("units_sold"),
        F.col(REVENUE).alias("revenue_eur"),
        F.col(BASE).alias("base_revenue_eur"),
        F.col(DISCOUNT).alias("discount_eur"),
    )
    adjusted = F.col("item_category")
    for pattern, category in reversed(cfg.category_remaps):
        adjusted = F.when(F.lower("product_name").like(pattern), F.lit(category)).otherwise(adjusted)
    return rows.withColumn("adjusted_category", adjusted)


SUMS = {c: c for c in ("revenue_eur", "base_revenue_eur", "discount_eur", "units_sold")}

# Labels of the switchable KPI.
SWITCHABLE = {
    "Revenue EUR": "revenue_eur",
    "Orders": "orders",
    "Customers": "customers",
    "Units Sold": "units_sold",
    "Discount Rate": "discount_rate",
    "Weighted Avg Selling Price EUR": "asp_eur",
    "Revenue Per Order EUR": "revenue_per_order_eur",
}


def _rates(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("discount_rate", safe_divide("discount_eur", "base_revenue_eur"))
        .withColumn("asp_eur", safe_divide("revenue_eur", "units_sold"))
        .withColumn("revenue_per_order_eur", safe_divide("revenue_eur", "orders"))
    )


def switchable_kpis(rows: DataFrame) -> DataFrame:
    monthly = rows.withColumn(MONTH, month_of("order_date"))
    rolled = _rates(measure_rollup(monthly, [MONTH, "item_category"], SUMS))
    return kpi_long(rolled, [MONTH, "item_category"], SWITCHABLE, "kpi_name", "kpi_value").orderBy(
        MONTH, "item_category", "kpi_name"
    )


def _totals(rows: DataFrame) -> DataFrame:
    return measure_rollup(rows, [], {"total_revenue": "revenue_eur"}).select(
        "total_revenue", F.col("orders").alias("total_orders"), F.col("customers").alias("total_customers")
    )


def _scale(rows: DataFrame, category: str, totals: DataFrame | None = None) -> DataFrame:
    return (
        _rates(with_totals(measure_rollup(rows, [category], SUMS), _totals(rows) if totals is None else totals))
        .withColumn("revenue_share", safe_divide("revenue_eur", "total_revenue"))
        .withColumn("order_penetration", safe_divide("orders", "total_orders"))
        .withColumn("customer_penetration", safe_divide("customers", "total_customers"))
    )


SCALE = (
    "revenue_eur", "revenue_share", "orders", "order_penetration", "customers", "customer_penetration", "units_sold",
)


def category_scale(rows: DataFrame) -> DataFrame:
    return _scale(rows, "item_category").select("item_category", *SCALE).orderBy(F.desc("revenue_eur"))


def adjusted_category_scale(rows: DataFrame) -> DataFrame:
    return (
        _scale(rows, "adjusted_category")
        .select("adjusted_category", *SCALE, "asp_eur", "discount_rate")
        .orderBy(F.desc("revenue_eur"))
    )


def category_quality(rows: DataFrame) -> DataFrame:
    """Price, discount, order size, loyalty and product concentration per category."""
    core = _rates(measure_rollup(rows, ["item_category"], SUMS))
    spread = concentration(rows, ["item_category"], "product_name", "revenue_eur")
    return (
        core.join(spread, "item_category")
        .orderBy(F.desc("revenue_eur"))
        .select(
            "item_category",
            "asp_eur",
            "discount_rate",
            "revenue_per_order_eur",
            safe_divide("units_sold", "orders").alias("units_per_order"),
            safe_divide("orders", "customers").alias("orders_per_customer"),
            safe_divide("repeat_customers", "customers").alias("repeat_customer_rate"),
            "sku_count",
            safe_divide("top_sku_revenue", "revenue_eur").alias("top_sku_share"),
            safe_divide("top_3_revenue", "revenue_eur").alias("top_3_share"),
        )
    )


def category_trend(rows: DataFrame) -> DataFrame:
    monthly = rows.withColumn(MONTH, month_of("order_date"))
    rolled = monthly.groupBy(MONTH, "item_category").agg(
        F.sum("revenue_eur").alias("revenue_eur"), F.sum("units_sold").alias("units_sold")
    )
    return rolled.orderBy(MONTH, F.desc("revenue_eur"), "item_category")


def attach_rates(rows: DataFrame, n: int = 50) -> DataFrame:
    """The n ordered category pairs with the highest share of base orders that also hold the other."""
    sets = basket_sets(rows, "order_sk", "item_category")
    base = member_counts(sets).select(F.col("a").alias("base_category"), F.col("orders").alias("base_orders"))
    pairs = directed_pairs(sets).select(
        F.col("a").alias("base_category"), F.col("b").alias("attached_category"),
        F.col("pair_orders").alias("attached_orders"),
    )
    rated = pairs.join(base, "base_category").select(
        "base_category", "attached_category", "base_orders", "attached_orders",
        safe_divide("attached_orders", "base_orders").alias("attach_rate"),
    )
    order = [F.desc("attach_rate"), F.desc("attached_orders"), F.asc("base_category"), F.asc("attached_category")]
    return top_n(rated, order, n)


def star_skus(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n products with the highest revenue and the categories they were sold under."""
    chosen = top_products(rows, "revenue_eur", n)
    theirs = null_safe_join(rows, F.broadcast(chosen), ["product_name"], "left_semi")  # n names
    best = _rates(measure_rollup(theirs, ["product_name"], SUMS))
    seen = (
        theirs.select("product_name", "item_category")
        .distinct()
        .groupBy("product_name")
        .agg(distinct_list("item_category").alias("category_mapping_in_file"))
    )
    total = rows.agg(F.sum("revenue_eur").alias("total_revenue"))
    return (
        with_totals(best.join(seen, "product_name"), total)
        .select(
            "product_name",
            "category_mapping_in_file",
            "revenue_eur",
            safe_divide("revenue_eur", "total_revenue").alias("revenue_share"),
            "orders",
            "customers",
            "asp_eur",
            "discount_rate",
        )
        .orderBy(F.desc("revenue_eur"), "product_name")
    )


# Wording of the four summary rows on the two dashboards.
SUMMARY_DEEP_DIVE = (
    "Raw-file winner category", "Adjusted winner category", "Revenue EUR: ",
    "Top 2 SKU revenue concentration", "% of total revenue",
    "Dipping -> Crisp attach rate", "% of dipping orders also include Crisp & Snacks",
)
SUMMARY_OVERVIEW = (
    "Raw top category", "Adjusted top category", "revenue_eur=",
    "Top 2 SKU concentration", "% of total revenue from top 2 products",
    "Dipping -> Crisps attach rate", "% of dipping orders that also include Crisp & Snacks",
)


def executive_summary(
    rows: DataFrame, cfg: Settings = Settings(), words: tuple[str, ...] = SUMMARY_DEEP_DIVE,
    base_category: str | None = None, attached_category: str | None = None,
) -> DataFrame:
    """Winning category before and after remapping, top-two concentration, and one attach rate."""
    raw_title, adjusted_title, prefix, top_title, top_note, attach_title, attach_note = words

    def winner(category: str, title: str) -> DataFrame:
        ranked = rows.groupBy(category).agg(F.sum("revenue_eur").alias("revenue"))
        best = top_n(ranked, [F.desc("revenue"), F.asc(category)], 1)
        return insight(best, title, F.col(category), F.concat(F.lit(prefix), plain_number("revenue", 2)))

    products = rows.groupBy("product_name").agg(F.sum("revenue_eur").alias("revenue"))
    top = top_n(products, [F.desc("revenue"), F.asc("product_name")], 2).agg(F.sum("revenue").alias("top"))
    share = with_totals(top, rows.agg(F.sum("revenue_eur").alias("total")))
    base, other = base_category or cfg.dip_category, attached_category or cfg.snack_category
    # other categories decide nothing: they are filtered before orders are folded
    flags = rows.where(F.col("item_category").isin(base, other)).groupBy(short_key(rows, "order_sk")).agg(
        F.max(F.col("item_category") == base).alias("has_base"),
        F.max(F.col("item_category") == other).alias("has_other"),
    )
    attach = flags.agg(
        safe_divide(count_where(F.col("has_base") & F.col("has_other")), count_where(F.col("has_base"))).alias("rate")
    )
    return reduce(
        DataFrame.unionByName,
        [
            winner("item_category", raw_title),
            winner("adjusted_category", adjusted_title),
            insight(share, top_title, plain_number(safe_divide("top", "total") * 100, 2), top_note),
            insight(attach, attach_title, plain_number(F.col("rate") * 100, 2), attach_note),
        ],
    )


# ------------------------------------------------------------------------------------ overview charts


def overview_kpis(rows: DataFrame) -> DataFrame:
    """One row: size of the period."""
    size = measure_rollup(rows.withColumn("one", F.lit(1)), [], {**SUMS, "order_item_rows": "one"})
    names = rows.select("item_key").distinct().agg(F.count("item_key").alias("products"))
    categories = rows.select("item_category").distinct().agg(F.count("item_category").alias("categories"))
    return with_totals(with_totals(size, names), categories).select(
        "order_item_rows",
        "orders",
        "customers",
        "products",
        "categories",
        "units_sold",
        F.round("revenue_eur", 2).alias("final_revenue_eur"),
        F.round("base_revenue_eur", 2).alias("base_revenue_eur"),
        F.round("discount_eur", 2).alias("discount_eur"),
        F.round(safe_divide("discount_eur", "base_revenue_eur"), 4).alias("discount_rate"),
    )


def raw_and_adjusted_scorecard(rows: DataFrame) -> DataFrame:
    totals = _totals(rows)  # one subquery for both views

    def view(kind: str, column: str) -> DataFrame:
        return _scale(rows, column, totals).select(
            F.lit(kind).alias("view_type"), F.col(column).alias("category"), *SCALE, "asp_eur", "discount_rate"
        )

    both = view("raw", "item_category").unionByName(view("adjusted", "adjusted_category"))
    return both.orderBy("view_type", F.desc("revenue_eur"))


def revenue_by_category(rows: DataFrame, column: str = "item_category") -> DataFrame:
    return (
        rows.groupBy(F.col(column).alias("category")).agg(F.sum("revenue_eur").alias("revenue_eur"))
        .orderBy(F.desc("revenue_eur"), "category")
    )


def revenue_trend(rows: DataFrame) -> DataFrame:
    keyed = rows.groupBy(month_of("order_date").alias(MONTH), F.col("item_category").alias("category"))
    return keyed.agg(F.sum("revenue_eur").alias("revenue_eur")).orderBy(MONTH, F.desc("revenue_eur"), "category")


def revenue_growth(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("category").orderBy(MONTH)
    before = F.lag("revenue_eur").over(w)
    monthly = revenue_trend(rows)
    ratio = safe_divide(F.col("revenue_eur") - before, before)
    return monthly.select(MONTH, "category", ratio.alias("mom_growth_ratio")).orderBy(MONTH, "category")


def discount_and_concentration(rows: DataFrame) -> DataFrame:
    spread = concentration(rows, ["item_category"], "product_name", "revenue_eur")
    discounts = rows.groupBy("item_category").agg(
        F.sum("discount_eur").alias("discount"), F.sum("base_revenue_eur").alias("base")
    )
    return (
        spread.join(discounts, "item_category")
        .orderBy(F.desc("group_revenue"))
        .select(
            F.col("item_category").alias("category"),
            safe_divide("discount", "base").alias("discount_rate"),
            safe_divide("top_sku_revenue", "group_revenue").alias("top_sku_share"),
            safe_divide("top_3_revenue", "group_revenue").alias("top_3_share"),
            "sku_count",
        )
    )

