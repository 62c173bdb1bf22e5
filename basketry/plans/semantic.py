"""A small metric layer: semantic models as data, metric queries as group-bys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import safe_divide
from basketry.operators.joins import with_totals

AGGREGATES = {
    "count": F.count,
    "sum": F.sum,
    # exact sum and one division: the result does not depend on how rows were distributed
    "average": lambda c: safe_divide(F.sum(c), F.count(c)),
    "count_distinct": F.count_distinct,
}
GRAINS = ("hour", "day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class SemanticModel:
    """A table with its keys, dimensions and measures.

    `time_dimensions` maps a column to its finest grain; `measures` maps a name to (aggregate, column).
    """

    name: str
    table: str
    primary: tuple[str, str]
    time: str
    foreign: Mapping[str, str] = field(default_factory=dict)
    dimensions: tuple[str, ...] = ()
    time_dimensions: Mapping[str, str] = field(default_factory=dict)
    measures: Mapping[str, tuple[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Metric:
    name: str
    label: str
    measure: str


def _summed(names: str) -> dict[str, tuple[str, str]]:
    return {n: ("sum", n) for n in names.split()}


# The six models with their entities, dimensions and measures.
MODELS: tuple[SemanticModel, ...] = (
    SemanticModel(
        "orders", "fct_order", ("order", "order_sk"), "order_date",
        foreign={"customer": "customer_sk"},
        dimensions=(
            "order_sk", "customer_sk", "purchase_key", "customer_key", "order_hour_utc", "order_hour_berlin",
            "order_day_name", "customer_order_number", "is_first_order_for_customer", "has_any_promo_units_in_order",
        ),
        time_dimensions={
            "order_date": "day", "order_date_utc": "day", "order_ts_utc": "hour", "order_ts_berlin": "hour",
        },
        measures={
            "order_count": ("count", "order_sk"),
            "avg_delivery_distance_line_meters": ("average", "delivery_distance_line_meters"),
            "total_basket_value_eur": ("sum", "total_basket_value_eur"),
            "total_service_fee_eur": ("sum", "service_fee_eur"),
            "total_courier_base_fee_eur": ("sum", "courier_base_fee_eur"),
            **_summed(
                "basket_plus_service_fee_eur total_customer_paid_eur total_units_in_order "
                "distinct_order_item_rows_in_order promo_order_item_rows_in_order promo_units_in_order "
                "derived_order_items_base_amount_gross_eur derived_order_items_discount_amount_gross_eur "
                "derived_order_items_final_amount_gross_eur"
            ),
        },
    ),
    SemanticModel(
        "order_items", "fct_order_item", ("order_item", "order_item_sk"), "order_date",
        foreign={"order": "order_sk", "customer": "customer_sk", "item": "item_key_sk"},
        dimensions=(
            "purchase_key", "customer_key", "customer_sk", "item_key", "item_scd_sk", "promo_sk", "item_name_en",
            "item_name_de", "item_category", "is_promo_item", "item_name_preferred", "brand_name",
        ),
        time_dimensions={"order_date": "day", "order_date_utc": "day", "order_ts_utc": "hour"},
        measures={
            "order_item_row_count": ("count", "order_item_sk"),
            "units_sold": ("sum", "units_in_order_item_row"),
            "item_unit_base_price_gross_eur": ("average", "item_unit_base_price_gross_eur"),
            "discount_pct_applied": ("average", "discount_pct_applied"),
            "item_unit_discount_amount_gross_eur": ("average", "item_unit_discount_amount_gross_eur"),
            "line_revenue_eur": ("sum", "order_item_row_final_amount_gross_eur"),
            "line_base_amount_eur": ("sum", "order_item_row_base_amount_gross_eur"),
            "line_discount_eur": ("sum", "order_item_row_discount_amount_gross_eur"),
            "avg_item_unit_final_price_gross_eur": ("average", "item_unit_final_price_gross_eur"),
            "avg_vat_rate_pct": ("average", "vat_rate_pct"),
        },
    ),
    SemanticModel(
        "customers", "dim_customer", ("customer", "customer_sk"), "first_order_ts_utc",
        dimensions=("customer_key", "first_order_contains_promo_flag"),
        time_dimensions={"first_order_ts_utc": "day", "last_order_ts_utc": "day"},
        measures={
            "customer_count": ("count", "customer_sk"),
            "customer_lifetime_orders": ("sum", "lifetime_orders"),
            "customer_lifetime_basket_value_eur": ("sum", "lifetime_basket_value_eur"),
            "customer_orders_with_promo": ("sum", "orders_with_promo"),
        },
    ),
    SemanticModel(
        "items", "dim_item_current", ("item", "item_key_sk"), "current_valid_from_utc",
        dimensions=(
            "item_key", "item_scd_sk", "item_category", "brand_name", "item_name_en", "item_name_de",
            "item_name_preferred",
        ),
        time_dimensions={"current_valid_from_utc": "day"},
        measures={
            "item_count_current": ("count", "item_key_sk"),
            "avg_current_item_base_price_gross_eur": ("average", "current_product_base_price_gross_eur"),
            "avg_current_vat_rate_pct": ("average", "current_vat_rate_pct"),
            "avg_number_of_units": ("average", "number_of_units"),
            "avg_weight_in_grams": ("average", "weight_in_grams"),
        },
    ),
    SemanticModel(
        "item_history", "dim_item_history", ("item_scd", "item_scd_sk"), "valid_from_utc",
        foreign={"item": "item_key_sk"},
        dimensions=(
            "item_key", "log_item_id", "is_current", "item_category", "brand_name", "item_name_en", "item_name_de",
            "item_name_preferred",
        ),
        time_dimensions={"valid_from_utc": "day", "valid_to_utc": "day", "time_item_created_in_source_utc": "day"},
        measures={
            "item_versions_count": ("count", "item_scd_sk"),
            "avg_item_base_price_history_gross_eur": ("average", "product_base_price_gross_eur"),
            "avg_item_vat_rate_history_pct": ("average", "vat_rate_pct"),
            "avg_item_number_of_units_history": ("average", "number_of_units"),
            "avg_item_weight_in_grams_history": ("average", "weight_in_grams"),
        },
    ),
    SemanticModel(
        "promos", "dim_promo", ("promo", "promo_sk"), "promo_start_date",
        foreign={"item": "item_key_sk"},
        dimensions=("promo_type", "item_key"),
        time_dimensions={"promo_start_date": "day", "promo_end_date": "day"},
        measures={"promo_rule_count": ("count", "promo_sk"), "avg_discount_pct": ("average", "discount_pct")},
    ),
)

# The metrics; each shows one measure.
METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("total_orders", "Total Orders", "order_count"),
        Metric("basket_value_eur", "Basket Value (EUR)", "total_basket_value_eur"),
        Metric("units_sold", "Units Sold", "units_sold"),
        Metric("item_unit_base_price_gross_eur", "Avg Item Unit Base Price Gross (EUR)", "item_unit_base_price_gross_eur"),
        Metric("discount_pct_applied", "Avg Discount Pct Applied", "discount_pct_applied"),
        Metric("item_unit_discount_amount_gross_eur", "Avg Item Unit Discount Amount Gross (EUR)",
               "item_unit_discount_amount_gross_eur"),
        Metric("line_revenue_eur", "Line Revenue (EUR)", "line_revenue_eur"),
        Metric("line_discount_eur", "Line Discount (EUR)", "line_discount_eur"),
        Metric("total_customer_paid_eur", "Total Customer Paid (EUR)", "total_customer_paid_eur"),
        Metric("total_units_in_order", "Total Units In Order", "total_units_in_order"),
        Metric("promo_units_in_order", "Promo Units In Order", "promo_units_in_order"),
        Metric("order_item_rows", "Order Item Rows", "order_item_row_count"),
        Metric("line_base_amount_eur", "Line Base Amount (EUR)", "line_base_amount_eur"),
        Metric("avg_item_unit_final_price_gross_eur", "Avg Item Unit Final Price Gross (EUR)",
               "avg_item_unit_final_price_gross_eur"),
        Metric("customers", "Customers", "customer_count"),
        Metric("customer_lifetime_orders", "Customer Lifetime Orders", "customer_lifetime_orders"),
        Metric("customer_lifetime_basket_value_eur", "Customer Lifetime Basket Value (EUR)",
               "customer_lifetime_basket_value_eur"),
        Metric("customer_orders_with_promo", "Customer Orders With Promo", "customer_orders_with_promo"),
        Metric("item_count_current", "Item Count Current", "item_count_current"),
        Metric("avg_current_item_base_price_gross_eur", "Avg Current Item Base Price Gross (EUR)",
               "avg_current_item_base_price_gross_eur"),
        Metric("item_versions_count", "Item Versions Count", "item_versions_count"),
        Metric("avg_item_base_price_history_gross_eur", "Avg Item Base Price History Gross (EUR)",
               "avg_item_base_price_history_gross_eur"),
        Metric("promo_rule_count", "Promo Rule Count", "promo_rule_count"),
        Metric("avg_discount_pct", "Avg Discount Pct", "avg_discount_pct"),
    )
}


def model_of(measure: str) -> SemanticModel:
    return next(m for m in MODELS if measure in m.measures)


def _truncate(column: Column, grain: str | None, kind: str) -> Column:
    if grain is None:
        return column
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}")
    cut = F.date_trunc(grain, column)
    return cut.cast("date") if kind == "day" and grain != "hour" else cut


def _with_dimension(df: DataFrame, model: SemanticModel, dim: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Make `entity__column` available by a left join on the entity's primary key (never multiplies rows)."""
    entity, column = dim.split("__", 1)
    if entity not in model.foreign:
        raise ValueError(f"{model.name} has no entity {entity!r}")
    parent = next(m for m in MODELS if m.primary[0] == entity)
    if column not in parent.dimensions and column not in parent.time_dimensions:
        raise ValueError(f"{parent.name} has no dimension {column!r}")
    side = tables[parent.table].select(F.col(parent.primary[1]).alias("__entity"), F.col(column).alias(dim))
    return df.join(side, F.col(model.foreign[entity]) == F.col("__entity"), "left").drop("__entity")


def _one_model(
    model: SemanticModel, metrics: Sequence[Metric], group_by: Sequence[str], grain: str | None,
    where: Column | str | None, tables: Mapping[str, DataFrame],
) -> DataFrame:
    df = tables[model.table]
    for dim in group_by:
        if "__" in dim:
            df = _with_dimension(df, model, dim, tables)
    if where is not None:
        df = df.where(where)
    keys = []
    for dim in group_by:
        if dim == "metric_time":
            keys.append(_truncate(F.col(model.time), grain or "day", "day").alias("metric_time"))
        elif dim in model.time_dimensions:
            keys.append(_truncate(F.col(dim), grain, model.time_dimensions[dim]).alias(dim))
        elif "__" in dim or dim in model.dimensions:
            keys.append(F.col(dim))
        else:
            raise ValueError(f"{model.name} has no dimension {dim!r}")
    aggs = []
    for metric in metrics:
        how, column = model.measures[metric.measure]
        aggs.append(AGGREGATES[how](column).alias(metric.name))
    return df.groupBy(*keys).agg(*aggs)


def metric_query(
    tables: Mapping[str, DataFrame],
    metrics: Sequence[str],
    group_by: Sequence[str] = (),
    grain: str | None = None,
    where: Column | str | None = None,
) -> DataFrame:
    """Metrics by dimensions.

    Dimensions are columns of the metric's model, `metric_time` (its default time column at `grain`) or
    `entity__column` of a related model. Metrics of several models are grouped separately and then joined on
    the dimensions, so no measure is multiplied by another model's rows.
    """
    chosen = [METRICS[m] for m in metrics]
    by_model: dict[str, list[Metric]] = {}
    for metric in chosen:
        by_model.setdefault(model_of(metric.measure).name, []).append(metric)
    results = [
        _one_model(next(m for m in MODELS if m.name == name), group, group_by, grain, where, tables)
        for name, group in by_model.items()
    ]
    out = results[0]
    for nxt in results[1:]:
        out = _outer(out, nxt, list(group_by)) if group_by else with_totals(out, nxt)
    return out.select(*group_by, *metrics)


def _outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on null-safe keys of two already grouped results."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    marked = left.withColumn("__l", F.lit(True)).join(renamed.withColumn("__r", F.lit(True)), cond, "full")
    return marked.select(
        *[F.when(F.col("__l"), F.col(k)).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys],
        *[c for c in left.columns + right.columns if c not in keys],
    )


# Column metrics of the marts as name -> (aggregate, column).
COLUMN_METRICS: dict[str, dict[str, tuple[str, str]]] = {
    "rpt_category_scorecard": {
        "cos_revenue_eur_sum": ("sum", "revenue_eur"),
        "cos_units_sum": ("sum", "units"),
        "cos_orders_sum": ("sum", "orders"),
        "cos_customers_sum": ("sum", "customers"),
        "cos_share_pct_avg": ("average", "share_pct"),
        "cos_order_pen_pct_avg": ("average", "order_pen_pct"),
        "cos_customer_pen_pct_avg": ("average", "customer_pen_pct"),
        "cos_asp_eur_avg": ("average", "asp_eur"),
        "cos_disc_pct_avg": ("average", "disc_pct"),
        "cos_promo_pct_avg": ("average", "promo_pct"),
        "cos_rev_per_order_eur_avg": ("average", "rev_per_order_eur"),
        "cos_orders_per_customer_avg": ("average", "orders_per_customer"),
        "cos_repeat_pct_avg": ("average", "repeat_pct"),
        "cos_top_sku_pct_avg": ("average", "top_sku_pct"),
        "cos_top_3_pct_avg": ("average", "top_3_pct"),
    },
    "rpt_category_monthly": {
        "cm_revenue_eur": ("sum", "revenue_eur"),
        "cm_discount_eur": ("sum", "discount_eur"),
        "cm_orders": ("sum", "orders"),
        "cm_customers": ("sum", "customers"),
        "cm_units_sold": ("sum", "units_sold"),
        "base_cm_revenue_eur": ("sum", "base_revenue_eur"),
        "promo_cm_units_sold": ("sum", "promo_units_sold"),
        "cm_avg_discount_rate": ("average", "discount_rate"),
        "cm_avg_revenue_share": ("average", "revenue_share"),
        "cm_avg_order_penetration": ("average", "order_penetration"),
        "cm_avg_customer_penetration": ("average", "customer_penetration"),
        "cm_avg_asp_eur": ("average", "asp_eur"),
        "cm_avg_revenue_per_order_eur": ("average", "revenue_per_order_eur"),
        "cm_avg_units_per_order": ("average", "units_per_order"),
        "cm_avg_orders_per_customer": ("average", "orders_per_customer"),
        "cm_avg_repeat_customer_rate": ("average", "repeat_customer_rate"),
        "cm_avg_sku_count": ("average", "sku_count"),
        "cm_avg_top_sku_share": ("average", "top_sku_share"),
        "cm_avg_top_3_share": ("average", "top_3_share"),
        "cm_avg_cross_sell_attach_rate": ("average", "cross_sell_attach_rate"),
    },
    "rpt_kpi_long": {
        "kpi_metric_value_sum": ("sum", "metric_value"),
    },
    "rpt_kpi_mom": {
        "kpi_mom_metric_value_sum": ("sum", "metric_value"),
        "kpi_mom_previous_metric_value_sum": ("sum", "previous_month_metric_value"),
        "kpi_mom_absolute_change_sum": ("sum", "mom_absolute_change"),
        "kpi_mom_percentage_change_avg": ("average", "mom_percentage_change"),
    },
    "rpt_star_products": {
        "star10_revenue_eur_sum": ("sum", "revenue_eur"),
        "star10_units_sum": ("sum", "units"),
        "star10_orders_sum": ("sum", "orders"),
        "star10_customers_sum": ("sum", "customers"),
        "star10_share_pct_avg": ("average", "share_pct"),
        "star10_asp_eur_avg": ("average", "asp_eur"),
        "star10_disc_pct_avg": ("average", "disc_pct"),
    },
    "rpt_customer_promo": {
        "rcp_orders_with_any_promo_units": ("sum", "orders_with_any_promo_units"),
        "rcp_orders_with_no_promo_units": ("sum", "orders_with_no_promo_units"),
        "rcp_promo_units_purchased": ("sum", "promo_units_purchased"),
        "rcp_non_promo_units_purchased": ("sum", "non_promo_units_purchased"),
        "rcp_promo_value_eur": ("sum", "promo_value_eur"),
        "rcp_non_promo_value_eur": ("sum", "non_promo_value_eur"),
    },
    "rpt_daypart": {
        "cdm_revenue_eur_sum": ("sum", "revenue_eur"),
        "cdm_units_sold_sum": ("sum", "units_sold"),
    },
    "rpt_category_pairs": {
        "cscp_pair_orders_sum": ("sum", "pair_orders"),
        "cscp_pair_orders_vs_expected_delta_sum": ("sum", "pair_orders_vs_expected_delta"),
        "cscp_support_avg": ("average", "support"),
        "cscp_expected_support_independent_avg": ("average", "expected_support_independent"),
        "cscp_expected_pair_orders_independent_avg": ("average", "expected_pair_orders_independent"),
        "cscp_pair_orders_vs_expected_pct_avg": ("average", "pair_orders_vs_expected_pct"),
        "cscp_confidence_a_to_b_avg": ("average", "confidence_a_to_b"),
        "cscp_confidence_b_to_a_avg": ("average", "confidence_b_to_a"),
        "cscp_lift_avg": ("average", "lift"),
        "cscp_actionability_rank_avg": ("average", "actionability_rank"),
    },
    "rpt_product_pairs": {
        "cspp_pair_orders_sum": ("sum", "pair_orders"),
        "cspp_pair_orders_vs_expected_delta_sum": ("sum", "pair_orders_vs_expected_delta"),
        "cspp_support_avg": ("average", "support"),
        "cspp_expected_support_independent_avg": ("average", "expected_support_independent"),
        "cspp_expected_pair_orders_independent_avg": ("average", "expected_pair_orders_independent"),
        "cspp_pair_orders_vs_expected_pct_avg": ("average", "pair_orders_vs_expected_pct"),
        "cspp_confidence_a_to_b_avg": ("average", "confidence_a_to_b"),
        "cspp_confidence_b_to_a_avg": ("average", "confidence_b_to_a"),
        "cspp_lift_avg": ("average", "lift"),
        "cspp_actionability_rank_avg": ("average", "actionability_rank"),
    },
    "fct_order_item": {
        "order_item_rows": ("count_distinct", "order_item_sk"),
        "orders": ("count_distinct", "order_sk"),
        "units_sold": ("sum", "units_in_order_item_row"),
        "avg_item_unit_final_price_gross_eur": ("average", "item_unit_final_price_gross_eur"),
        "total_discount_gross_eur": ("sum", "order_item_row_discount_amount_gross_eur"),
        "total_revenue_gross_eur": ("sum", "order_item_row_final_amount_gross_eur"),
    },
}


def column_metrics(df: DataFrame, table: str, group_by: Sequence[str] = (), metrics: Sequence[str] | None = None) -> DataFrame:
    """Column metrics of one mart, all of them unless some are named."""
    known = COLUMN_METRICS[table]
    return df.groupBy(*group_by).agg(
        *[AGGREGATES[known[m][0]](known[m][1]).alias(m) for m in (metrics or known)]
    )

