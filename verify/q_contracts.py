"""Contracts of all layers and the checks of whole tables; their statements count over the statements of the tables."""

from __future__ import annotations

from basketry.plans import core, quality
from verify import q_core, q_reports  # noqa: F401
from verify.oracle_base import sql
from verify.q_audit import _HASH
from verify.registry import ORACLE, add

# table: the query whose statement gives its rows, with at least the columns of its contracts
ROWS = {
    "stg_item_logs": "stg1_item_logs",
    "stg_promos": "stg4_promos",
    "stg_purchases": "stg2_purchases",
    "stg_order_items": "stg3_explode_basket",
    "int_item_logs": "cur4_curated_logs",
    "int_item_scd2": "scd3_item_windows",
    "int_priced": "fct2_order_item",
    "int_promoted": "fct2_order_item",
    "int_order_rollups": "fct1_order",
    "dim_item_history": "dim2_item_history",
    "dim_item_current": "dim3_item_current",
    "dim_promo": "dim4_promo",
    "dim_customer": "dim5_customer",
    "fct_order": "fct1_order",
    "fct_order_item": "fct2_order_item",
    "rpt_category_scorecard": "rpt4_category_scorecard",
    "rpt_category_monthly": "rpt1_category_monthly",
    "rpt_kpi_long": "rpt2_kpi_long",
    "rpt_kpi_mom": "rpt3_kpi_mom",
    "rpt_star_products": "rpt5_star_products",
    "rpt_customer_promo": "rpt9_customer_promo",
    "rpt_daypart": "rpt6_daypart",
    "rpt_category_pairs": "rpt7_category_pairs",
    "rpt_product_pairs": "rpt8_product_pairs",
    "aud_item_log_curation": "aud1_curation",
    "aud_item_log_curation_summary": "aud2_curation_summary",
    "aud_order_item_match": "aud3_item_match",
    "aud_order_item_match_summary": "aud4_item_match_summary",
    "aud_row_flow": "aud11_row_flow",
    "aud_row_flow_summary": "aud12_row_flow_summary",
    "aud_promo_coverage": "aud5_promo_coverage",
    "aud_promo_coverage_summary": "aud6_promo_coverage_summary",
    "aud_promo_anomaly": "aud9_promo_anomaly",
    "aud_promo_anomaly_summary": "aud10_promo_anomaly_summary",
    "aud_price_anomaly": "aud7_price_anomaly",
    "aud_price_anomaly_summary": "aud8_price_anomaly_summary",
    "aud_control_status": "aud14_control_status",
    "aud_issue_details": "aud13_issue_details",
}
# statements of tables that no query returns whole
OTHER = {
    "int_purchases": "select purchase_key, customer_key, time_order_received_utc from ({stg2_purchases}) where time_order_received_utc is not null",
    "dim_date": "select cast(d as date) as date_day from generate_series(date '1995-01-01', date '2001-12-31', interval 1 day) s(d)",
}
# filled by the build itself, not part of any statement
NEVER_NULL = {("aud_control_status", "failing_rows_with_reason")}


def _statement(table: str) -> str:
    return ORACLE[ROWS[table]] if table in ROWS else OTHER[table].format(**ORACLE)


def _counts(kind: str) -> str:
    """Failing rows per contract of a kind, one pass over each table's statement."""
    parts = []
    for table in dict.fromkeys(c.table for c in quality.CONTRACTS if c.kind == kind):
        mine = [c for c in quality.CONTRACTS if c.kind == kind and c.table == table]
        rows = []
        for c in mine:
            if kind == "unique":
                failing = f"count({c.column}) filter (n > 1)"
            elif (table, c.column) in NEVER_NULL:
                failing = "0"
            else:
                failing = f"count(*) filter ({c.column} is null)"
            rows.append(f"{{column_name: '{c.column}', severity: '{c.severity}', failing_rows: cast({failing} as bigint)}}")
        source = _statement(table)
        if kind == "unique":
            source = f"select {mine[0].column}, count(*) as n from ({source}) group by all"
        parts.append(f"select '{table}' as table_name, unnest([{', '.join(rows)}], recursive := true) from ({source})")
    return (
        f"select table_name, column_name, '{kind}' as check_kind, severity, failing_rows, "
        "case when failing_rows = 0 then 'pass' when severity = 'warn' then 'warn' else 'fail' end as status from ("
        + " union all ".join(parts) + ")"
    )


def _tables(w, s) -> dict:
    return {**w, "dim_date": core.dim_date(s, "1995-01-01", "2001-12-31")}


def _report(kind: str):
    def run(w, s, d):
        names = {c.table for c in quality.CONTRACTS if c.kind == kind}
        held = _tables(w, s)
        tables = {n: held[n] for n in (*names, *(c.parent for c in quality.CONTRACTS if c.kind == kind and c.parent))}
        return quality.contract_report(tables, [c for c in quality.CONTRACTS if c.kind == kind])

    return run


def _relations() -> str:
    parts = []
    for c in quality.CONTRACTS:
        if c.kind == "relationship":
            parent = f"select cast({c.parent_column} as varchar) as p from ({_statement(c.parent)})"
            failing = f"(select count(*) from ({_statement(c.table)}) where cast({c.column} as varchar) not in ({parent}))"
            parts.append(f"select '{c.table}' as table_name, '{c.column}' as column_name, '{c.severity}' as severity, {failing} as failing_rows")
    return (
        "select table_name, column_name, 'relationship' as check_kind, severity, failing_rows, "
        "case when failing_rows = 0 then 'pass' when severity = 'warn' then 'warn' else 'fail' end as status from ("
        + " union all ".join(parts) + ")"
    )


# failing rows of the checks of whole tables, over the statements of what they read
SINGULAR = {
    "order_items_have_item_history": "{dq4_unmatched_items}",
    "derived_order_revenue_matches_raw": "{dq5_revenue_vs_raw}",
    "item_log_prices_positive": "select * from ({cur4_curated_logs}) where not coalesce(product_base_price_gross_eur > 0, false)",
    "item_log_curation_consistent": "select * from ({aud1_curation}) where curation_consistency_status like 'error%'",
    "no_repeated_item_states": sql(f"select 1 from (select *, {_HASH} as h from scd) qualify lag(h) over (partition by item_key order by valid_from, item_scd_sk) = h"),
    "no_critical_item_price_anomalies": "{dq9_price_anomalies}",
    "no_critical_promo_discount_anomalies": "{dq10_promo_anomalies}",
    "no_duplicate_item_times": "select item_key, time_log_created_utc from ({cur4_curated_logs}) group by all having count(*) > 1",
    "no_duplicate_promos": "{dq12_duplicate_promos}",
    "no_negative_values": "select 1 from ({fct1_order}) where total_basket_value_eur < 0 or service_fee_eur < 0 or courier_base_fee_eur < 0 union all "
    "select 1 from ({fct2_order_item}) where units_in_order_item_row <= 0 or item_unit_base_price_gross_eur < 0 or order_item_row_final_amount_gross_eur < 0",
    "no_overlapping_item_versions": "select * from ({dim2_item_history}) qualify valid_to_utc > lead(valid_from_utc) over (partition by item_key_sk order by valid_from_utc, item_scd_sk)",
    "no_overlapping_promos": "with q as (select distinct item_key, promo_start_date as s, promo_end_date as e, promo_type, discount_pct, count(*) over (partition by item_key, promo_start_date, promo_end_date, promo_type, discount_pct) as n "
    "from ({stg4_promos}) where promo_start_date < promo_end_date) select * from q a where n > 1 or exists (select 1 from q x where x.item_key = a.item_key and x.s < a.e and a.s < x.e "
    "and (x.s, x.e, coalesce(x.promo_type, ''), coalesce(x.discount_pct, -1)) <> (a.s, a.e, coalesce(a.promo_type, ''), coalesce(a.discount_pct, -1)))",
    "no_backward_item_versions": "select * from ({dim2_item_history}) where valid_to_utc <= valid_from_utc",
    "no_negative_delivery_distance": "select * from ({fct1_order}) where delivery_distance_line_meters < 0",
    "order_item_value_bounds": "select * from ({fct2_order_item}) where vat_rate_pct < 0 or vat_rate_pct > 100 or "
    "order_item_row_discount_amount_gross_eur - order_item_row_base_amount_gross_eur > 0.01",
    "order_reconciliation": "{dq19_order_reconciliation}",
    "promo_items_exist": "{dq20_promo_items}",
    "valid_promo_windows": "{dq21_promo_windows}",
}


def _singular() -> str:
    severity = {name: level for name, level, _ in quality.SINGULAR}
    parts = [f"select '{name}' as check_name, '{severity[name]}' as severity, (select count(*) from ({text.format(**ORACLE) if '{' in text else text})) as failing_rows" for name, text in SINGULAR.items()]
    return (
        "select *, case when failing_rows = 0 then 'pass' when severity = 'warn' then 'warn' else 'fail' end as status from ("
        + " union all ".join(parts) + ")"
    )


for number, kind in ((1, "not_null"), (2, "unique")):
    add(f"dq{number}_{kind}_all_layers", _report(kind))
    ORACLE[f"dq{number}_{kind}_all_layers"] = _counts(kind)
add("dq3_contracts", _report("relationship"))
ORACLE["dq3_contracts"] = _relations()
add("dq4_to_21_report", lambda w, s, d: quality.singular_report(w))
ORACLE["dq4_to_21_report"] = _singular()
