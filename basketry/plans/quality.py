"""Data-quality checks: each returns the failing rows, so an empty result means pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import try_money
from basketry.operators.history import TRACKED, with_previous_state
from basketry.operators.temporal import overlapping_windows
from basketry.operators.timeline import split_neighbours

TOLERANCE = 0.001


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number of rows; nulls are ignored."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.where(F.col("row_count") > 1)


def relationship(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose key is missing from the parent; null keys are ignored."""
    known = parent.select(F.col(parent_column).alias("__parent"))
    return df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__parent"), "left_anti")


def unmatched_order_items(priced: DataFrame) -> DataFrame:
    missing = F.col("item_key_sk").isNull() | F.col("item_scd_sk").isNull()
    return priced.where(missing).select("order_item_sk", "purchase_key", "item_key", "time_order_received_utc")


def derived_by_order(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Sum of item rows per order; zero for an order without items."""
    sums = items.groupBy("order_sk").agg(F.sum("order_item_row_final_amount_gross_eur").alias("s"))
    return orders.join(sums, "order_sk", "left").select(
        "order_sk", "purchase_key", "total_basket_value_eur", F.coalesce("s", F.lit(0)).alias("derived_basket_value_eur")
    )


def revenue_reconciliation(raw_purchases: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose item rows do not add up to the total of their one raw purchase row."""
    parsed = raw_purchases.select("purchase_key", try_money("total_basket_value").alias("raw"))
    raw = parsed.groupBy("purchase_key").agg(
        F.count(F.lit(1)).alias("raw_row_count"),
        F.count_distinct("raw").alias("raw_distinct_total_count"),
        F.max("raw").alias("raw_total_basket_value_eur"),
    )
    derived = derived_by_order(orders, items).select("purchase_key", "derived_basket_value_eur")
    joined = derived.join(raw, "purchase_key", "left")
    total = F.col("raw_total_basket_value_eur")
    diff = F.abs(F.col("derived_basket_value_eur") - total)
    reason = (
        F.when(F.col("raw_row_count").isNull(), "missing_raw_purchase_key")
        .when(F.col("raw_row_count") != 1, "duplicate_raw_purchase_key_rows")
        .when(total.isNull(), "raw_total_basket_value_unparsable")
        .when(diff > F.lit(TOLERANCE), "derived_vs_raw_value_mismatch")
    )
    return joined.select(
        "purchase_key",
        "derived_basket_value_eur",
        "raw_total_basket_value_eur",
        "raw_row_count",
        "raw_distinct_total_count",
        F.abs(F.col("derived_basket_value_eur") - F.coalesce(total, F.lit(0))).alias("abs_diff"),
        reason.alias("failure_reason"),
    ).where(F.col("failure_reason").isNotNull())


def non_positive_prices(curated: DataFrame) -> DataFrame:
    price = F.col("product_base_price_gross_eur")
    return curated.where(price.isNull() | (price <= 0))


CURATION_ERRORS = ("error_expected_but_missing_in_curated", "error_unexpected_present_in_curated")


def curation_mismatches(curation_audit: DataFrame) -> DataFrame:
    return curation_audit.where(F.col("curation_consistency_status").isin(*CURATION_ERRORS))


def repeated_states(history: DataFrame, unit: str = "hour") -> DataFrame:
    """Versions that do not differ from the version before them."""
    states = with_previous_state(history, "item_key_sk", "valid_from_utc", ["item_scd_sk"], TRACKED, unit)
    same = F.col("attribute_state_hash") == F.col("previous_attribute_state_hash")
    return states.where(same).select(
        "item_key_sk", "valid_from_utc", "item_scd_sk", "attribute_state_hash", "previous_attribute_state_hash"
    )


def critical_price_anomalies(anomalies: DataFrame) -> DataFrame:
    return anomalies.where(F.col("anomaly_severity") == "critical").select(
        "log_item_id", "item_key", "time_log_created_utc", "item_price_gross_eur", "prev_item_price_gross_eur",
        "price_ratio_vs_prev", "anomaly_reason",
    )


def critical_promo_anomalies(anomalies: DataFrame) -> DataFrame:
    return anomalies.where(F.col("anomaly_severity") == "critical").select(
        "promo_sk", "item_key", "promo_start_date", "promo_end_date", "discount_pct", "anomaly_reason"
    )


def duplicate_item_times(curated: DataFrame) -> DataFrame:
    counted = curated.groupBy("item_key", "time_log_created_utc").agg(F.count(F.lit(1)).alias("row_cnt"))
    return counted.where(F.col("row_cnt") > 1)


def duplicate_promos(promos: DataFrame) -> DataFrame:
    keys = ["item_key", "promo_start_date", "promo_end_date", "promo_type", "discount_pct"]
    return promos.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def negative_values(purchases: DataFrame, items: DataFrame) -> DataFrame:
    bad_orders = (
        (F.col("total_basket_value_eur") < 0) | (F.col("service_fee_eur") < 0) | (F.col("courier_base_fee_eur") < 0)
    )
    bad_items = (
        (F.col("units_in_order_item_row") <= 0)
        | (F.col("item_unit_base_price_gross_eur") < 0)
        | (F.col("order_item_row_final_amount_gross_eur") < 0)
    )
    return (
        purchases.where(bad_orders)
        .select(F.lit("orders").alias("entity"), F.col("purchase_key").alias("entity_id"))
        .unionByName(
            items.where(bad_items).select(
                F.lit("order_items").alias("entity"), F.col("order_item_sk").alias("entity_id")
            )
        )
    )


def overlapping_versions(history: DataFrame, unit: str = "hour") -> DataFrame:
    nexted = split_neighbours(
        history.select("item_key_sk", "item_scd_sk", "valid_from_utc", "valid_to_utc"),
        ["item_key_sk"], "valid_from_utc", ["item_scd_sk"], leads={"next_valid_from_utc": "valid_from_utc"}, unit=unit,
    )
    return nexted.where(F.col("valid_to_utc") > F.col("next_valid_from_utc"))


def overlapping_promos(promos: DataFrame) -> DataFrame:
    """Promotion windows that overlap others of their item, with the number of rows each of them meets."""
    return overlapping_windows(
        promos, "item_key", "promo_start_date", "promo_end_date", ["promo_type", "discount_pct"]
    )


def backward_versions(history: DataFrame) -> DataFrame:
    return history.where(F.col("valid_to_utc") <= F.col("valid_from_utc"))


def negative_distance(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("delivery_distance_line_meters") < 0)


def value_bounds(items: DataFrame) -> DataFrame:
    over = F.col("order_item_row_discount_amount_gross_eur") - F.col("order_item_row_base_amount_gross_eur")
    vat = F.col("vat_rate_pct")
    return items.where((vat < 0) | (vat > 100) | (over > F.lit("0.01").cast("decimal(3,2)")))


def order_reconciliation(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose total differs from the sum of their item rows."""
    diff = F.abs(F.col("total_basket_value_eur") - F.col("derived_basket_value_eur"))
    return (
        derived_by_order(orders, items)
        .withColumn("abs_diff", diff)
        .where(F.col("abs_diff") > F.lit(TOLERANCE))
        .select("order_sk", "total_basket_value_eur", "derived_basket_value_eur", "abs_diff")
    )


def promos_without_item(coverage: DataFrame) -> DataFrame:
    return coverage.where(~F.col("in_dim_item_current_flag")).select(
        "promo_sk", "item_key", "promo_start_date", "promo_end_date"
    )


def invalid_promo_windows(promos: DataFrame) -> DataFrame:
    pct = F.col("discount_pct")
    return promos.where((F.col("promo_end_date") <= F.col("promo_start_date")) | (pct < 0) | (pct > 100))


# --------------------------------------------------------------------------------- declared contracts


@dataclass(frozen=True)
class Check:
    """A column contract: kind is not_null, unique or relationship (with parent table and column)."""

    table: str
    column: str
    kind: str
    severity: str = "error"
    parent: str | None = None
    parent_column: str | None = None


# Columns that must not be null, by layer and table.
NOT_NULL: dict[str, tuple[str, ...]] = {
    "stg_item_logs": ("log_item_id", "item_key", "time_log_created_utc"),
    "stg_promos": ("item_key", "promo_start_date", "promo_end_date", "discount_pct"),
    "stg_purchases": ("purchase_key", "customer_key", "time_order_received_utc"),
    "stg_order_items": ("purchase_key", "item_key", "item_count"),
    "int_item_logs": ("log_item_id", "item_key", "time_log_created_utc", "product_base_price_gross_eur"),
    "int_purchases": ("purchase_key", "customer_key", "time_order_received_utc"),
    "int_item_scd2": ("item_scd_sk", "item_key_sk", "valid_from_utc", "valid_to_utc"),
    "int_priced": ("order_item_sk", "order_sk", "customer_sk", "item_scd_sk"),
    "int_promoted": ("order_item_sk", "order_sk", "item_key_sk"),
    "int_order_rollups": ("order_sk", "customer_sk", "customer_order_number"),
    "dim_date": ("date_day",),
    "dim_item_history": ("item_scd_sk", "item_key_sk", "item_key"),
    "dim_item_current": ("item_key", "item_key_sk", "item_scd_sk"),
    "dim_promo": ("promo_sk", "item_key_sk", "item_key"),
    "dim_customer": ("customer_sk", "customer_key"),
    "fct_order": (
        "order_sk", "customer_sk", "purchase_key", "customer_key", "order_date", "order_ts_berlin", "order_hour_berlin",
        "customer_order_number", "is_first_order_for_customer",
    ),
    "fct_order_item": (
        "order_item_sk", "order_sk", "customer_sk", "purchase_key", "customer_key", "item_key", "item_key_sk", "item_scd_sk",
        "order_date", "order_ts_utc", "order_date_utc",
    ),
    "rpt_category_scorecard": ("category",),
    "rpt_category_monthly": ("order_month", "item_category"),
    "rpt_kpi_long": ("order_month", "item_category", "metric_name", "metric_value"),
    "rpt_kpi_mom": ("order_month", "item_category", "metric_name", "metric_value"),
    "rpt_star_products": ("rank_no", "product_name"),
    "rpt_customer_promo": (
        "customer_sk", "customer_key", "first_order_had_any_promo_units", "first_order_had_only_promo_units",
    ),
    "rpt_daypart": (
        "order_month", "item_category", "day_of_week_berlin_num", "day_of_week_berlin", "order_hour_berlin", "daypart_berlin",
    ),
    "rpt_category_pairs": ("category_a", "category_b"),
    "rpt_product_pairs": ("product_a", "product_b"),
    "aud_item_log_curation": ("log_item_id",),
    "aud_item_log_curation_summary": (
        "raw_row_count", "stg_row_count", "curated_row_count", "curated_distinct_item_key_count", "int_item_scd2_row_count",
        "int_item_scd2_distinct_item_key_count", "dim_item_history_row_count", "dim_item_history_distinct_item_key_count",
        "dim_item_current_row_count", "dim_item_current_distinct_item_key_count", "expected_in_curated_count",
        "actually_in_curated_count", "excluded_invalid_time_count", "excluded_invalid_price_count",
        "excluded_item_timestamp_conflict_count", "error_expected_but_missing_count", "error_unexpected_present_count",
        "overall_curation_state", "overall_curation_state_reason", "problematic_log_item_id_count",
        "problematic_item_key_count", "expected_exclusion_log_item_id_count",
    ),
    "aud_order_item_match": ("order_item_sk", "purchase_key", "item_key", "item_match_status"),
    "aud_order_item_match_summary": (
        "unmatched_order_item_rows", "affected_purchase_count", "affected_item_key_count", "overall_match_state",
        "overall_match_state_reason",
    ),
    "aud_row_flow": ("chain_name", "step_order", "object_name", "row_count", "status"),
    "aud_row_flow_summary": (
        "total_steps", "matching_steps", "attention_required_steps", "review_required_steps", "baseline_reference_steps",
        "overall_pipeline_flow_state", "overall_pipeline_flow_state_reason",
    ),
    "aud_promo_coverage": ("promo_sk", "item_key", "in_dim_item_current_flag", "coverage_status"),
    "aud_promo_coverage_summary": (
        "promo_row_count", "promo_rows_mapped_to_item_dim_count", "promo_rows_missing_item_dim_count",
        "overall_coverage_state", "overall_coverage_state_reason",
    ),
    "aud_promo_anomaly": ("promo_sk", "item_key", "discount_pct", "anomaly_severity", "anomaly_reason"),
    "aud_promo_anomaly_summary": (
        "promo_rows_checked", "warning_rows", "critical_rows", "overall_promo_anomaly_state",
        "overall_promo_anomaly_state_reason",
    ),
    "aud_price_anomaly": ("log_item_id", "item_key", "item_price_gross_eur", "anomaly_severity", "anomaly_reason"),
    "aud_price_anomaly_summary": (
        "item_log_rows_checked", "warning_rows", "critical_rows", "overall_item_price_anomaly_state",
        "overall_item_price_anomaly_state_reason",
    ),
    "aud_control_status": (
        "control_name", "control_description", "status", "severity", "problematic_row_count", "reason",
        "failing_issue_count", "failing_rows_with_reason",
    ),
    "aud_issue_details": ("issue_domain", "issue_severity", "issue_reason", "primary_entity_id"),
}
# The key of each table that has one.
UNIQUE: dict[str, str] = {
    "stg_purchases": "purchase_key",
    "int_item_logs": "log_item_id",
    "int_purchases": "purchase_key",
    "int_item_scd2": "item_scd_sk",
    "int_priced": "order_item_sk",
    "int_promoted": "order_item_sk",
    "int_order_rollups": "order_sk",
    "dim_date": "date_day",
    "dim_item_history": "item_scd_sk",
    "dim_item_current": "item_key_sk",
    "dim_promo": "promo_sk",
    "dim_customer": "customer_sk",
    "fct_order": "order_sk",
    "fct_order_item": "order_item_sk",
    "aud_item_log_curation": "log_item_id",
    "aud_order_item_match": "order_item_sk",
}
# Contracts that warn; all others are errors.
WARN = {("fct_order_item", "item_key_sk", "not_null"), ("fct_order_item", "item_scd_sk", "not_null"), ("dim_promo", "item_key_sk", "relationship")}
# Keys and the table and column in which each must occur.
RELATIONSHIPS = (
    ("dim_item_current", "item_scd_sk", "dim_item_history", "item_scd_sk"),
    ("dim_promo", "item_key_sk", "dim_item_current", "item_key_sk"),
    ("fct_order", "customer_sk", "dim_customer", "customer_sk"),
    ("fct_order", "order_date", "dim_date", "date_day"),
    ("fct_order_item", "order_sk", "fct_order", "order_sk"),
    ("fct_order_item", "customer_sk", "dim_customer", "customer_sk"),
    ("fct_order_item", "item_key_sk", "dim_item_current", "item_key_sk"),
    ("fct_order_item", "item_scd_sk", "dim_item_history", "item_scd_sk"),
    ("fct_order_item", "order_date", "dim_date", "date_day"),
)


def _severity(table: str, column: str, kind: str) -> str:
    return "warn" if (table, column, kind) in WARN else "error"


CONTRACTS: list[Check] = [
    *[Check(t, c, "not_null", _severity(t, c, "not_null")) for t, columns in NOT_NULL.items() for c in columns],
    *[Check(t, c, "unique", _severity(t, c, "unique")) for t, c in UNIQUE.items()],
    *[Check(t, c, "relationship", _severity(t, c, "relationship"), parent, pc) for t, c, parent, pc in RELATIONSHIPS],
]


def run_check(check: Check, tables: Mapping[str, DataFrame]) -> DataFrame:
    df = tables[check.table]
    if check.kind == "not_null":
        return not_null(df, check.column)
    if check.kind == "unique":
        return unique(df, check.column)
    return relationship(df, check.column, tables[check.parent], check.parent_column)


def column_contracts(df: DataFrame, table: str, checks: Sequence[Check]) -> DataFrame:
    """(column_name, check_kind, severity, failing_rows) of all null and uniqueness contracts of one table, in one scan.

    Where a key must be unique, rows are folded to it first, with their nulls counted; the fold answers everything. Further keys
    of the same table, if it has any, are folded on their own.
    """
    nulls = [c for c in checks if c.kind == "not_null"]
    keys = [c for c in checks if c.kind == "unique"]
    names = {c: f"{k}_{c.kind}" for k, c in enumerate((*nulls, *keys[:1]))}
    missing = [F.count_if(F.col(c.column).isNull()).alias(names[c]) for c in nulls]
    if keys:
        folded = df.groupBy(F.col(keys[0].column).alias("__key")).agg(F.count(F.lit(1)).alias("__n"), *missing)
        repeated = F.count_if(F.col("__key").isNotNull() & (F.col("__n") > 1)).alias(names[keys[0]])
        row = folded.agg(*[F.coalesce(F.sum(names[c]), F.lit(0)).alias(names[c]) for c in nulls], repeated)
    else:
        row = df.agg(*missing)
    described = F.array(*[
        F.struct(F.lit(c.column).alias("column_name"), F.lit(c.kind).alias("check_kind"), F.lit(c.severity).alias("severity"), F.col(name).alias("failing_rows"))
        for c, name in names.items()
    ])
    out = row.select(F.inline(described))
    for c in keys[1:]:
        out = out.unionByName(column_contracts(df, table, [c]))
    return out


def _with_status(rows: DataFrame) -> DataFrame:
    failed = F.col("failing_rows") > 0
    status = F.when(~failed, "pass").when(F.col("severity") == "warn", "warn").otherwise("fail")
    return rows.withColumn("status", status)


def contract_report(tables: Mapping[str, DataFrame], checks: Sequence[Check] = CONTRACTS) -> DataFrame:
    """Failing-row count and status per contract, for the contracts whose tables are given.

    All null and uniqueness contracts of one table share a single scan.
    """
    present = [c for c in checks if c.table in tables and (c.parent is None or c.parent in tables)]
    parts = []
    for table in dict.fromkeys(c.table for c in present):
        mine = [c for c in present if c.table == table]
        columns = [c for c in mine if c.kind != "relationship"]
        if columns:
            parts.append(column_contracts(tables[table], table, columns).select(F.lit(table).alias("table_name"), "*"))
        for c in mine:
            if c.kind == "relationship":
                parts.append(
                    run_check(c, tables).agg(F.count(F.lit(1)).alias("failing_rows")).select(
                        F.lit(table).alias("table_name"), F.lit(c.column).alias("column_name"),
                        F.lit(c.kind).alias("check_kind"), F.lit(c.severity).alias("severity"), "failing_rows",
                    )
                )
    return _with_status(reduce(DataFrame.unionByName, parts))


# Checks of whole tables: name, severity, and the failing rows out of the tables of the build.
SINGULAR: tuple[tuple[str, str, Callable[[Mapping[str, DataFrame]], DataFrame]], ...] = (
    ("order_items_have_item_history", "warn", lambda t: unmatched_order_items(t["int_priced"])),
    ("derived_order_revenue_matches_raw", "error", lambda t: revenue_reconciliation(t["raw_purchases"], t["fct_order"], t["fct_order_item"])),
    ("item_log_prices_positive", "error", lambda t: non_positive_prices(t["int_item_logs"])),
    ("item_log_curation_consistent", "error", lambda t: curation_mismatches(t["aud_item_log_curation"])),
    ("no_repeated_item_states", "error", lambda t: repeated_states(t["int_item_scd2"])),
    ("no_critical_item_price_anomalies", "warn", lambda t: critical_price_anomalies(t["aud_price_anomaly"])),
    ("no_critical_promo_discount_anomalies", "warn", lambda t: critical_promo_anomalies(t["aud_promo_anomaly"])),
    ("no_duplicate_item_times", "error", lambda t: duplicate_item_times(t["int_item_logs"])),
    ("no_duplicate_promos", "error", lambda t: duplicate_promos(t["stg_promos"])),
    ("no_negative_values", "error", lambda t: negative_values(t["int_purchases"], t["fct_order_item"])),
    ("no_overlapping_item_versions", "error", lambda t: overlapping_versions(t["int_item_scd2"])),
    ("no_overlapping_promos", "error", lambda t: overlapping_promos(t["stg_promos"])),
    ("no_backward_item_versions", "error", lambda t: backward_versions(t["int_item_scd2"])),
    ("no_negative_delivery_distance", "error", lambda t: negative_distance(t["fct_order"])),
    ("order_item_value_bounds", "error", lambda t: value_bounds(t["fct_order_item"])),
    ("order_reconciliation", "error", lambda t: order_reconciliation(t["fct_order"], t["fct_order_item"])),
    ("promo_items_exist", "warn", lambda t: promos_without_item(t["aud_promo_coverage"])),
    ("valid_promo_windows", "error", lambda t: invalid_promo_windows(t["stg_promos"])),
)


def singular_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(check_name, severity, failing_rows, status) of the checks of whole tables."""
    parts = [
        rows(tables).agg(F.count(F.lit(1)).alias("failing_rows")).select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), "failing_rows")
        for name, severity, rows in SINGULAR
    ]
    return _with_status(reduce(DataFrame.unionByName, parts))
