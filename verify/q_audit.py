"""Audit marts and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import surrogate_key
from basketry.functions.scalars import utc_text
from basketry.operators import curation
from basketry.operators.history import TRACKED, validity_windows
from basketry.plans import audit, core, quality
from verify.oracle_base import CTES, b, n, r, sk, t
from verify.registry import add

RUN = "'2024-01-01 00:00:00'"


def ids(source: str, column: str, where: str = "true") -> str:
    """First 200 distinct ids, joined; empty text if there are none."""
    return (
        f"coalesce((select string_agg(x, '|' order by x) from (select distinct {column} as x from {source} where {where} "
        "order by 1 limit 200)), '')"
    )


def count(source: str, where: str = "true", what: str = "*") -> str:
    return f"(select count({what}) from {source} where {where})"


add(
    "aud1_curation",
    lambda w, s, d: w["aud_item_log_curation"],
    f"select log_item_id, raw_n as raw_row_count, n as stg_row_count, no_time as stg_rows_with_null_time, timed as stg_rows_with_valid_time, "
    f"good as stg_rows_with_positive_price, bad as stg_rows_with_invalid_price, {t('c_ts', 'best_candidate_time_log_created_utc')}, "
    f"{n('c_price', 'best_candidate_price_gross_eur')}, why like 'included%' as expected_in_curated_flag, why as expected_reason, "
    f"there as in_curated_flag, {t('k_ts', 'curated_time_log_created_utc')}, {n('k_price', 'curated_price_gross_eur')}, "
    "case when why like 'included%' and there then 'ok_expected_and_present' when not there and why not like 'included%' "
    "then 'ok_expected_exclusion__' || why when there then 'error_unexpected_present_in_curated' "
    "else 'error_expected_but_missing_in_curated' end as curation_consistency_status from cur_audit",
)
_BAD = "(why like 'included%') <> there"
add(
    "aud2_curation_summary",
    lambda w, s, d: w["aud_item_log_curation_summary"],
    f"select {count('raw_logs')} as raw_row_count, {count('raw_logs', what='distinct log_item_id')} as raw_distinct_log_item_id_count, "
    f"{count('stg_logs')} as stg_row_count, {count('stg_logs', what='distinct log_item_id')} as stg_distinct_log_item_id_count, "
    f"{count('logs_cur')} as curated_row_count, {count('logs_cur', what='distinct log_item_id')} as curated_distinct_log_item_id_count, "
    f"{count('logs_cur', what='distinct item_key')} as curated_distinct_item_key_count, {count('scd')} as int_item_scd2_row_count, "
    f"{count('scd', what='distinct item_key')} as int_item_scd2_distinct_item_key_count, {count('scd')} as dim_item_history_row_count, "
    f"{count('scd', what='distinct item_key')} as dim_item_history_distinct_item_key_count, {count('scd', 'is_current')} as dim_item_current_row_count, "
    f"{count('scd', 'is_current', 'distinct item_key')} as dim_item_current_distinct_item_key_count, {count('cur_audit')} as audit_log_item_id_count, "
    "(select count(*) from cur_audit where why like 'included%') as expected_in_curated_count, "
    f"{count('cur_audit', 'there')} as actually_in_curated_count, "
    "(select count(*) from cur_audit where why = 'excluded_all_rows_invalid_time') as excluded_invalid_time_count, "
    "(select count(*) from cur_audit where why = 'excluded_best_candidate_invalid_price') as excluded_invalid_price_count, "
    "(select count(*) from cur_audit where why = 'excluded_by_item_timestamp_conflict_resolution') as excluded_item_timestamp_conflict_count, "
    "(select count(*) from cur_audit where why like 'included%' and there) as ok_expected_and_present_count, "
    "(select count(*) from cur_audit where why like 'excluded%' and not there) as ok_expected_exclusion_count, "
    "(select count(*) from cur_audit where why like 'included%' and not there) as error_expected_but_missing_count, "
    "(select count(*) from cur_audit where why like 'excluded%' and there) as error_unexpected_present_count, "
    "case when (select count(*) from cur_audit where why like 'excluded%') > 0 then 'warning_expected_exclusions_present' else 'ok' end as overall_curation_state, "
    "case when (select count(*) from cur_audit where why like 'excluded%') > 0 then 'expected_exclusions_present_review_if_unusual' "
    "else 'all_expected_log_item_ids_present_with_no_mismatch' end as overall_curation_state_reason, "
    f"{ids('cur_audit', 'log_item_id', _BAD)} as problematic_log_item_ids, '' as problematic_item_keys, "
    f"{count('cur_audit', _BAD)} as problematic_log_item_id_count, cast(0 as bigint) as problematic_item_key_count, "
    f"{ids('cur_audit', 'log_item_id', 'not there')} as expected_exclusion_log_item_ids, {count('cur_audit', 'not there')} as expected_exclusion_log_item_id_count",
)
_MISS = "item_scd_sk is null"
add(
    "aud3_item_match",
    lambda w, s, d: w["aud_order_item_match"],
    f"select order_item_sk, order_sk, purchase_key, customer_sk, customer_key, {t('ts', 'order_ts_utc')}, {t('order_date')}, item_key, item_key_sk, "
    f"item_scd_sk, units as units_in_order_item_row, {n('unit_price', 'item_unit_base_price_gross_eur')}, {n('final', 'order_item_row_final_amount_gross_eur')}, "
    f"'missing_item_entity_and_version' as item_match_status from items where {_MISS}",
)
add(
    "aud4_item_match_summary",
    lambda w, s, d: w["aud_order_item_match_summary"],
    f"select count(*) as unmatched_order_item_rows, count(distinct purchase_key) as affected_purchase_count, count(distinct item_key) as affected_item_key_count, "
    f"{t('min(ts)', 'first_unmatched_order_ts_utc')}, {t('max(ts)', 'latest_unmatched_order_ts_utc')}, "
    "case when count(*) = 0 then 'ok' else 'warning_unmatched_items_present' end as overall_match_state, "
    "case when count(*) = 0 then 'all_order_items_mapped_to_item_dimensions' else 'some_order_items_missing_item_dim_mapping' end as overall_match_state_reason, "
    f"{ids('items', 'order_item_sk', _MISS)} as problematic_order_item_sks, {ids('items', 'purchase_key', _MISS)} as problematic_purchase_keys, "
    f"{ids('items', 'item_key', _MISS)} as problematic_item_keys from items where {_MISS}",
)
add(
    "aud5_promo_coverage",
    lambda w, s, d: w["aud_promo_coverage"],
    f"select promo_sk, item_key_sk, item_key, kind as promo_type, pct as discount_pct, {t('s', 'promo_start_date')}, {t('e', 'promo_end_date')}, "
    "found as in_dim_item_current_flag, case when found then 'ok_mapped' else 'warning_missing_item_in_dim_current' end as coverage_status from coverage",
)
add(
    "aud6_promo_coverage_summary",
    lambda w, s, d: w["aud_promo_coverage_summary"],
    "select count(*) as promo_row_count, count(*) filter (where found) as promo_rows_mapped_to_item_dim_count, "
    "count(*) filter (where not found) as promo_rows_missing_item_dim_count, "
    "case when bool_and(found) then 'ok' else 'warning_missing_item_mapping' end as overall_coverage_state, "
    "case when bool_and(found) then 'all_promos_mapped_to_current_item_dim' else 'some_promos_missing_current_item_dim_mapping' end as overall_coverage_state_reason, "
    f"{ids('coverage', 'promo_sk', 'not found')} as missing_mapping_promo_sks, {ids('coverage', 'item_key', 'not found')} as missing_mapping_item_keys from coverage",
)
add(
    "aud7_price_anomaly",
    lambda w, s, d: w["aud_price_anomaly"],
    f"select {RUN} as audit_generated_at_utc, log_item_id, item_key, {t('ts', 'time_log_created_utc')}, {n('price', 'item_price_gross_eur')}, "
    f"{n('prev', 'prev_item_price_gross_eur')}, obs as item_obs_count, {n('p25', 'item_p25_price')}, {n('p50', 'item_p50_price')}, {n('p75', 'item_p75_price')}, "
    f"{n('p95', 'item_p95_price')}, {n('iqr', 'item_iqr_price')}, {r('ratio', 'price_ratio_vs_prev')}, false as invalid_price_flag, extreme as extreme_jump_flag, "
    "large as large_jump_flag, stat as statistical_price_outlier_flag, sev as anomaly_severity, why as anomaly_reason from price_anom",
)


def _severity(level: str) -> str:
    return f"sev = '{level}'"


def anomaly_summary(source: str, checked: str, reasons: dict[str, str], subject: str, noun: str, samples: list[tuple[str, str, str]]) -> str:
    counts = ", ".join(f"count(*) filter (where why = '{v}') as {k}" for k, v in reasons.items())
    lists = ", ".join(f"{ids(source, col, _severity(level))} as {name}" for name, level, col in samples)
    crit, warn = "count(*) filter (where sev = 'critical') > 0", "count(*) filter (where sev = 'warning') > 0"
    return (
        f"select {RUN} as latest_audit_generated_at_utc, count(*) as {checked}, count(*) filter (where sev = 'ok') as ok_rows, "
        f"count(*) filter (where sev = 'warning') as warning_rows, count(*) filter (where sev = 'critical') as critical_rows, {counts}, "
        f"case when {crit} then 'error_critical_anomalies_present' when {warn} then 'warning_statistical_anomalies_present' else 'ok' end as overall_{subject}_anomaly_state, "
        f"case when {crit} then 'critical_{noun}_anomalies_need_review' when {warn} then 'non_critical_{noun}_anomalies_detected' "
        f"else 'no_{noun}_anomalies_detected' end as overall_{subject}_anomaly_state_reason, {lists} from {source}"
    )


add(
    "aud8_price_anomaly_summary",
    lambda w, s, d: w["aud_price_anomaly_summary"],
    anomaly_summary(
        "price_anom", "item_log_rows_checked",
        {"statistical_outlier_rows": "price_statistical_outlier", "large_jump_rows": "large_price_jump_vs_previous_log",
         "extreme_jump_rows": "extreme_price_jump_vs_previous_log", "non_positive_or_null_rows": "non_positive_or_null_price"},
        "item_price", "item_price",
        [("critical_log_item_ids", "critical", "log_item_id"), ("critical_item_keys", "critical", "item_key"), ("warning_log_item_ids", "warning", "log_item_id")],
    ),
)
add(
    "aud9_promo_anomaly",
    lambda w, s, d: w["aud_promo_anomaly"],
    f"select {RUN} as audit_generated_at_utc, promo_sk, item_key, kind as promo_type, {t('s', 'promo_start_date')}, {t('e', 'promo_end_date')}, pct as discount_pct, "
    "obs as item_obs_count, p50 as item_p50_discount_pct, p95 as item_p95_discount_pct, iqr as item_iqr_discount_pct, g_obs as global_obs_count, "
    "g50 as global_p50_discount_pct, g95 as global_p95_discount_pct, g_iqr as global_iqr_discount_pct, hard as hard_invalid_discount_flag, "
    "extreme as extreme_discount_flag, stat as statistically_high_discount_flag, sev as anomaly_severity, why as anomaly_reason from promo_anom",
)
add(
    "aud10_promo_anomaly_summary",
    lambda w, s, d: w["aud_promo_anomaly_summary"],
    anomaly_summary(
        "promo_anom", "promo_rows_checked",
        {"statistical_outlier_rows": "discount_statistical_outlier", "extreme_discount_rows": "discount_at_or_above_90", "hard_invalid_discount_rows": "discount_outside_0_100"},
        "promo", "promo_discount",
        [("critical_promo_sks", "critical", "promo_sk"), ("critical_item_keys", "critical", "item_key"), ("warning_promo_sks", "warning", "promo_sk")],
    ),
)

# Each step: chain, order, object, grain, rows, distinct keys, rows before, kind of rule, text, diagnostic.
D = "distinct {}".format
CTES["flow_n"] = ", ".join([
    f"select {count('raw_buys')} as b0", f"{count('raw_buys', 'ts is null')} as b_null", f"{count('buys')} as b2",
    f"{count('lines')} as l1", f"{count('lines', what=D('purchase_key'))} as l1p", f"{count('lines', what=D('item_key'))} as l1i",
    f"{count('priced')} as p2", f"{count('priced', 'item_scd_sk is null')} as p2u", f"{count('items')} as i4", f"{count('ords')} as o1",
    f"{count('raw_logs')} as g1", f"{count('raw_logs', what=D('log_item_id'))} as g1k", f"{count('raw_logs', what=D('item_key'))} as g1i",
    f"{count('raw_logs', 'ts is null')} as g_null", f"{count('logs_cur')} as c3", f"{count('logs_cur', what=D('item_key'))} as c3i",
    f"{count('scd')} as s1", f"{count('scd', what=D('item_key'))} as s1i", f"{count('scd', 'is_current')} as s3",
    f"{count('stg_promo')} as q1", f"{count('stg_promo', what=D('item_key'))} as q1i", f"{count('promo_dim')} as q3",
    f"{count('promo_dim', what=D('item_key'))} as q3i", f"{count('coverage', 'not found')} as q3m",
    "(select count(*) from cur_audit where why = 'excluded_all_rows_invalid_time') as x_time",
    "(select count(*) from cur_audit where why = 'excluded_best_candidate_invalid_price') as x_price",
    "(select count(*) from cur_audit where why = 'excluded_by_item_timestamp_conflict_resolution') as x_slot",
])
_STEPS = [
    ("purchase_chain", 1, "raw.purchase_logs", "purchase_key", "b0", "b0", None, "base", "Baseline raw purchase events.", "null"),
    ("purchase_chain", 2, "stg_purchase_logs", "purchase_key", "b0", "b0", "b0", "same", "Expected same grain/near-same row count as raw after typing.",
     "'stg_null_event_time_rows=' || b_null || '; raw_minus_stg=0'"),
    ("purchase_chain", 3, "int_purchase_logs_curated_filtered", "purchase_key", "b2", "b2", "b0", "same", "Expected same grain, may drop invalid-event-time rows.",
     "'potential_dropped_rows=' || (b0 - b2)"),
    ("order_item_chain", 1, "stg_order_items", "purchase_key x item_key", "l1", "l1p", None, "base",
     "Expected row expansion vs purchase grain because basket JSON is exploded to item grain.", "'distinct_item_keys=' || l1i"),
    ("order_item_chain", 2, "int_order_items_with_item_price", "purchase_key x item_key", "p2", "l1p", "l1", "same",
     "Expected same row count after SCD2 time-valid price lookup.", "'unmatched_item_rows=' || p2u"),
    ("order_item_chain", 3, "int_order_items_with_price_then_promo", "purchase_key x item_key", "i4", "l1p", "p2", "same",
     "Expected same row count after promo matching (one row per order_item_sk).", "null"),
    ("order_item_chain", 4, "fct_order_item", "order_item_sk", "i4", "i4", "i4", "same", "Expected same row count as promoted intermediate.",
     "'unmatched_item_rows=' || p2u"),
    ("order_chain", 1, "fct_order", "order_sk", "o1", "o1", "b2", "same", "Expected one row per curated purchase.", "null"),
    ("item_log_chain", 1, "raw.item_logs", "log_item_id", "g1", "g1k", None, "base", "Baseline raw item-log events.", "'distinct_item_keys=' || g1i"),
    ("item_log_chain", 2, "stg_item_logs", "log_item_id", "g1", "g1k", "g1", "same", "Expected near-same row count after parsing/typing.",
     "'stg_null_event_time_rows=' || g_null || '; distinct_item_keys_raw=' || g1i || '; distinct_item_keys_stg=' || g1i"),
    ("item_log_chain", 3, "int_item_logs_curated_deduped", "log_item_id", "c3", "c3", "g1", "fewer",
     "Expected fewer or equal rows after curation (invalid/conflicting rows removed).",
     "'curation_removed_rows=' || (g1 - c3) || '; distinct_item_keys_curated=' || c3i || '; excluded_invalid_time=' || x_time || '; excluded_invalid_price=' || x_price "
     "|| '; excluded_item_timestamp_conflict=' || x_slot"),
    ("item_dim_chain", 1, "int_item_scd2", "item_scd_sk", "s1", "s1", None, "base", "SCD2 versions derived from curated item logs.", "'distinct_item_keys_scd2=' || s1i"),
    ("item_dim_chain", 2, "dim_item_history", "item_scd_sk", "s1", "s1", "s1", "same", "Expected same row count as SCD2 source.", "'distinct_item_keys_history=' || s1i"),
    ("item_dim_chain", 3, "dim_item_current", "item_key_sk", "s3", "s3", "s1", "fewer", "Expected lower row count than history (one current row per item).",
     "'distinct_item_keys_current=' || s3 || '; distinct_item_keys_raw=' || g1i"),
    ("promo_chain", 1, "raw.promos", "item_key + promo window", "q1", "q1i", None, "base", "Baseline raw promo rules.", "null"),
    ("promo_chain", 2, "stg_promos", "item_key + promo window", "q1", "q1i", "q1", "same", "Expected near-same rows after typing/standardization.", "null"),
    ("promo_chain", 3, "dim_promo", "promo_sk", "q3", "q3", "q1", "map", "Promo rule rows; should mostly map to current item dimension.",
     "'promo_rows_missing_item_dim=' || q3m || '; distinct_item_keys_dim_promo=' || q3i"),
]


def _step(x) -> str:
    chain, order, name, grain, rows, keys, before, rule, text, note = x
    prev = before or "cast(null as bigint)"
    status = {
        "base": "'baseline_reference'",
        "same": f"case when {rows} = {prev} then 'matches_expectation' else 'review_required' end",
        "fewer": f"case when {rows} <= {prev} then 'matches_expectation' else 'review_required' end",
        "map": "case when q3m = 0 then 'matches_expectation' else 'attention_required' end",
    }[rule]
    return (
        f"select '{chain}' as chain_name, cast({order} as bigint) as step_order, '{name}' as object_name, '{grain}' as primary_grain_key, {rows} as row_count, "
        f"{keys} as distinct_primary_key_count, {prev} as prev_step_row_count, {rows} - {prev} as row_delta_from_prev, '{text}' as expected_behavior, "
        f"{status} as status, cast({note} as varchar) as diagnostic_reason from flow_n"
    )


CTES["flow"] = " union all ".join(_step(x) for x in _STEPS)
add("aud11_row_flow", lambda w, s, d: w["aud_row_flow"], f"select {RUN} as audit_generated_at_utc, * from flow")


def _named(kind: str) -> str:
    return f"coalesce((select string_agg(chain_name || '::' || object_name, '|' order by chain_name, step_order) from flow where status = '{kind}'), '')"


add(
    "aud12_row_flow_summary",
    lambda w, s, d: w["aud_row_flow_summary"],
    "select count(*) as total_steps, count(*) filter (where status = 'matches_expectation') as matching_steps, "
    "count(*) filter (where status = 'attention_required') as attention_required_steps, count(*) filter (where status = 'review_required') as review_required_steps, "
    f"count(*) filter (where status = 'baseline_reference') as baseline_reference_steps, {RUN} as latest_audit_generated_at_utc, "
    "case when count(*) filter (where status = 'review_required') > 0 then 'error_review_required_steps_present' "
    "when count(*) filter (where status = 'attention_required') > 0 then 'warning_attention_required_steps_present' else 'ok' end as overall_pipeline_flow_state, "
    "case when count(*) filter (where status = 'review_required') > 0 then 'one_or_more_steps_have_unexpected_row_flow' "
    "when count(*) filter (where status = 'attention_required') > 0 then 'one_or_more_steps_have_known_risk_to_monitor' "
    "else 'all_steps_match_or_are_baseline_reference' end as overall_pipeline_flow_state_reason, "
    f"{_named('review_required')} as review_required_step_objects, {_named('attention_required')} as attention_required_step_objects from flow",
)
_AT = "cast(cast({} as timestamp) as varchar)".format
CTES["issues"] = f"""
select 'order_item_item_mapping' as issue_domain, 'warning' as issue_severity, 'missing_item_entity_and_version' as issue_reason,
  order_item_sk as primary_entity_id, item_key as secondary_entity_id, {_AT('ts')} as event_ts_utc, cast(final as double) as metric_value,
  to_json(struct_pack(purchase_key := purchase_key, customer_key := customer_key, item_key_sk := item_key_sk, item_scd_sk := item_scd_sk,
    units_in_order_item_row := units, item_unit_base_price_gross_eur := cast(unit_price as double)))::varchar as context_payload
from items where item_scd_sk is null
union all select 'promo_item_mapping', 'warning', 'warning_missing_item_in_dim_current', promo_sk, item_key, {_AT('s')}, cast(pct as double),
  to_json(struct_pack(promo_type := kind, promo_start_date := s, promo_end_date := e, in_dim_item_current_flag := found))::varchar
from coverage where not found
union all select 'promo_discount_anomaly', sev, why, promo_sk, item_key, {_AT('s')}, cast(pct as double),
  to_json(struct_pack(promo_type := kind, promo_start_date := s, promo_end_date := e, item_obs_count := obs, item_p95_discount_pct := p95,
    global_p95_discount_pct := g95, hard_invalid_discount_flag := hard, extreme_discount_flag := extreme, statistically_high_discount_flag := stat))::varchar
from promo_anom where sev <> 'ok'
union all select 'item_price_anomaly', sev, why, log_item_id, item_key, {_AT('ts')}, cast(price as double),
  to_json(struct_pack(prev_item_price_gross_eur := cast(prev as double), price_ratio_vs_prev := ratio, item_obs_count := obs, item_p95_price := cast(p95 as double),
    invalid_price_flag := false, extreme_jump_flag := extreme, large_jump_flag := large, statistical_price_outlier_flag := stat))::varchar
from price_anom where sev <> 'ok'
union all select 'pipeline_row_flow', case status when 'review_required' then 'critical' else 'warning' end, status, chain_name || '::' || object_name,
  cast(step_order as varchar), {RUN}, cast(row_delta_from_prev as double),
  to_json(struct_pack(chain_name := chain_name, object_name := object_name, primary_grain_key := primary_grain_key, row_count := row_count,
    distinct_primary_key_count := distinct_primary_key_count, prev_step_row_count := prev_step_row_count, status := status,
    expected_behavior := expected_behavior, diagnostic_reason := diagnostic_reason))::varchar
from flow where status in ('review_required', 'attention_required')
union all select 'order_revenue_reconciliation', 'critical', why, purchase_key, null, null, cast(gap as double),
  to_json(struct_pack(derived_basket_value_eur := cast(derived as double), raw_total_basket_value_eur := cast(raw as double), raw_row_count := 1,
    raw_distinct_total_count := case when raw is null then 0 else 1 end))::varchar
from recon
"""
add(
    "aud13_issue_details",
    lambda w, s, d: w["aud_issue_details"],
    f"select {RUN} as issue_generated_at_utc, issue_domain, issue_severity, issue_reason, primary_entity_id, secondary_entity_id, event_ts_utc, "
    "round(metric_value, 6) as metric_value, context_payload from issues",
)
CTES["controls"] = f"""
select 'item_logs_curation' as control_name, case when (select count(*) from cur_audit where why like 'excluded%') > 0
    then 'warning_expected_exclusions_present' else 'ok' end as status, {count('cur_audit', _BAD)} as bad,
  case when (select count(*) from cur_audit where why like 'excluded%') > 0 then 'expected_exclusions_present_review_if_unusual'
    else 'all_expected_log_item_ids_present_with_no_mismatch' end as reason, {ids('cur_audit', 'log_item_id', _BAD)} as p, '' as q
union all select 'order_item_item_mapping', case when {count('items', _MISS)} = 0 then 'ok' else 'warning_unmatched_items_present' end, {count('items', _MISS)},
  case when {count('items', _MISS)} = 0 then 'all_order_items_mapped_to_item_dimensions' else 'some_order_items_missing_item_dim_mapping' end,
  {ids('items', 'order_item_sk', _MISS)}, {ids('items', 'item_key', _MISS)}
union all select 'promo_item_mapping', case when {count('coverage', 'not found')} = 0 then 'ok' else 'warning_missing_item_mapping' end, {count('coverage', 'not found')},
  case when {count('coverage', 'not found')} = 0 then 'all_promos_mapped_to_current_item_dim' else 'some_promos_missing_current_item_dim_mapping' end,
  {ids('coverage', 'promo_sk', 'not found')}, {ids('coverage', 'item_key', 'not found')}
""" + "".join(
    f"""
union all select '{name}', case when k > 0 then 'error_critical_anomalies_present' when w > 0 then 'warning_statistical_anomalies_present' else 'ok' end, k + w,
  case when k > 0 then 'critical_{noun}_anomalies_need_review' when w > 0 then 'non_critical_{noun}_anomalies_detected' else 'no_{noun}_anomalies_detected' end,
  {ids(source, key, "sev = 'critical'")}, {ids(source, 'item_key', "sev = 'critical'")}
from (select count(*) filter (where sev = 'critical') as k, count(*) filter (where sev = 'warning') as w from {source})"""
    for name, noun, source, key in (
        ("promo_discount_anomaly", "promo_discount", "promo_anom", "promo_sk"), ("item_price_anomaly", "item_price", "price_anom", "log_item_id"),
    )
) + f"""
union all select 'pipeline_row_flow', case when rv > 0 then 'error_review_required_steps_present' when aq > 0 then 'warning_attention_required_steps_present' else 'ok' end,
  rv + aq, case when rv > 0 then 'one_or_more_steps_have_unexpected_row_flow' when aq > 0 then 'one_or_more_steps_have_known_risk_to_monitor'
    else 'all_steps_match_or_are_baseline_reference' end, {_named('review_required')}, {_named('attention_required')}
from (select count(*) filter (where status = 'review_required') as rv, count(*) filter (where status = 'attention_required') as aq from flow)
union all select 'order_revenue_reconciliation', case when {count('recon')} = 0 then 'ok' else 'error_order_revenue_reconciliation_mismatch' end, {count('recon')},
  case when {count('recon')} = 0 then 'all_orders_reconcile_between_derived_and_raw_totals'
    else 'one_or_more_orders_do_not_reconcile_between_derived_and_raw_totals' end, {ids('recon', 'purchase_key')}, ''
"""
_TEXT = " ".join(f"when '{k}' then '{v}'" for k, v in audit.CONTROL_TEXT.items())


def _board(w, s, d):
    rows = F.col("failing_rows_with_reason")
    first = F.get_json_object(F.get(rows, F.lit(0)), "$.primary_entity_id")
    last = F.get_json_object(F.try_element_at(rows, F.lit(-1)), "$.primary_entity_id")
    return w["aud_control_status"].select(
        "*", F.size(rows).alias("shown"), first.alias("first_shown"), last.alias("last_shown")
    ).drop("failing_rows_with_reason")


add(
    "aud14_control_status",
    _board,
    f"select {RUN} as audit_generated_at_utc, control_name, case control_name {_TEXT} end as control_description, status, "
    "case when starts_with(status, 'error') then 'critical' when starts_with(status, 'warning') then 'warning' else 'ok' end as severity, "
    "cast(bad as bigint) as problematic_row_count, reason, coalesce(k, 0) as failing_issue_count, p as sample_primary_ids, q as sample_secondary_ids, "
    "coalesce(shown, 0) as shown, first_shown, last_shown from controls left join ("
    "select issue_domain, any_value(k) as k, count(*) as shown, arg_min(primary_entity_id, rn) as first_shown, arg_max(primary_entity_id, rn) as last_shown from ("
    "select *, count(*) over (partition by issue_domain) as k, row_number() over (partition by issue_domain order by issue_severity desc, issue_reason, "
    "primary_entity_id, secondary_entity_id nulls first) as rn from issues) where rn <= 200 group by issue_domain) on issue_domain = control_name",
)
_RECON = (
    f"select purchase_key, {n('derived', 'derived_basket_value_eur')}, {n('raw', 'raw_total_basket_value_eur')}, 1::bigint as raw_row_count, "
    f"cast(case when raw is null then 0 else 1 end as bigint) as raw_distinct_total_count, {n('gap', 'abs_diff')}, why as failure_reason from recon"
)
add(
    "aud15_reconciliation",
    lambda w, s, d: quality.revenue_reconciliation(w["raw_purchases"], w["fct_order"], w["fct_order_item"]),
    _RECON,
)


def _checks(section: str, source: str, **values: str) -> list[str]:
    return [f"select '{section}' as section, '{k}' as check_name, cast({v} as varchar) as check_value from {source}" for k, v in values.items()]


_POS = "coalesce(price > 0, false)"
_VALIDATION = " union all ".join([
    *_checks("layers", "raw_buys", stg_purchase_rows="count(*)"),
    *_checks("layers", "buys", int_purchase_rows="count(*)"),
    *_checks("layers", "ords", fct_order_rows="count(*)"),
    *_checks("layers", "lines", stg_order_items_rows="count(*)"),
    *_checks("layers", "items", fct_order_item_rows="count(*)", items_missing_scd_match_cnt="count(*) - count(item_scd_sk)"),
    *_checks("layers", "(select order_sk from items where order_sk not in (select order_sk from ords))", orphan_fct_order_item_without_order="count(*)"),
    *_checks("layers", "(select order_sk from ords where order_sk not in (select order_sk from items))", fct_order_without_items="count(*)"),
    *_checks("layers", "(select abs(total - final) as dd from ords)", order_reconciliation_max_abs_diff="max(dd)",
             order_reconciliation_over_0_001_cnt="count(*) filter (where dd > 0.001)"),
    *_checks("layers", "(select 1 from stg_promo group by item_key, s, e, kind, pct having count(*) > 1)", duplicate_promo_definitions_cnt="count(*)"),
    *_checks("item_logs", "stg_logs", stg_item_logs_rows="count(*)", stg_distinct_log_item_id="count(distinct log_item_id)",
             stg_invalid_price_null_or_non_positive=f"count(*) filter (where not {_POS})", stg_brand_name_null_rows="count(*) - count(brand_name)"),
    *_checks("item_logs", "logs_cur", curated_rows="count(*)", curated_distinct_log_item_id="count(distinct log_item_id)",
             curated_brand_name_null_rows="count(*) - count(brand_name)"),
    *_checks("item_logs", "(select count(*) as c from stg_logs group by log_item_id having count(*) > 1)", stg_duplicate_log_item_groups="count(*)",
             stg_duplicate_extra_rows="cast(coalesce(sum(c - 1), 0) as bigint)"),
    *_checks("purchases", "raw_buys", raw_purchase_rows="count(*)", stg_time_order_received_null="count(*) - count(ts)", stg_item_basket_json_null="count(*) * 0",
             stg_total_basket_value_null="count(*) - count(total)", stg_service_fee_null="count(*) - count(service)",
             stg_courier_fee_null="count(*) - count(courier)", stg_delivery_distance_null="count(*) - count(distance)"),
    *_checks("purchases", "(select 1 from raw_buys where purchase_key not in (select purchase_key from lines))", stg_orders_without_exploded_items="count(*)"),
    *_checks("versions", "scd", scd_rows="count(*)", scd_current_rows="count(*) filter (where is_current)",
             scd_zero_length_rows="count(*) filter (where valid_from = valid_to)"),
    *_checks("versions", "(select 1 from scd group by item_key, valid_from having count(*) > 1)", item_keys_with_same_timestamp_multi_logs="count(*)"),
    *_checks("promos", "(select count(*) as c from buys group by customer_key, ts having count(*) > 1)", customers_with_same_timestamp_multi_orders="count(*)",
             max_orders_same_customer_same_ts="coalesce(max(c), 0)"),
    *_checks("promos", "(select 1 from priced a join stg_promo p on p.item_key = a.item_key and a.day_local >= p.s and a.day_local < p.e group by order_item_sk having count(*) > 1)",
             order_items_with_multiple_promo_matches="count(*)"),
    *_checks("promos", "(select 1 from stg_promo where item_key not in (select item_key from scd))", promo_rows_for_unknown_items="count(*)"),
    *_checks("promos", "items", fct_order_item_discount_gt_base_rows="count(*) filter (where row_disc - base > 0.000001)"),
])
add("aud16_validation", lambda w, s, d: audit.validation_checks(w), _VALIDATION)

# --------------------------------------------------------------------------------- quality checks

add("dq1_not_null", lambda w, s, d: quality.not_null(w["stg_purchases"], "time_order_received_utc").select("purchase_key"),
    "select purchase_key from raw_buys where ts is null")
add("dq2_unique", lambda w, s, d: quality.unique(w["stg_item_logs"], "log_item_id"),
    "select log_item_id, count(*) as row_count from stg_logs group by all having count(*) > 1")
add("dq3_relationship", lambda w, s, d: quality.relationship(w["dim_promo"], "item_key_sk", w["dim_item_current"], "item_key_sk").select("promo_sk", "item_key"),
    "select promo_sk, item_key from coverage where not found")
add("dq4_unmatched_items", lambda w, s, d: quality.unmatched_order_items(w["int_priced"]),
    f"select order_item_sk, purchase_key, item_key, {t('ts', 'time_order_received_utc')} from priced where item_scd_sk is null")
add("dq5_revenue_vs_raw", lambda w, s, d: quality.revenue_reconciliation(w["raw_purchases"], w["fct_order"], w["fct_order_item"]), _RECON)
add("dq6_positive_prices", lambda w, s, d: quality.non_positive_prices(w["stg_item_logs"]).select("log_item_id", "product_base_price_gross_eur"),
    f"select log_item_id, {n('price', 'product_base_price_gross_eur')} from stg_logs where not coalesce(price > 0, false)")


def _mismatch(w, s, d):
    """The audit of curated logs against a curated table that skipped conflict resolution."""
    loose = curation.require_positive(
        curation.best_per_log(curation.drop_null_event_time(w["stg_item_logs"], "time_log_created_utc")), curation.PRICE
    )
    found = audit.item_log_curation(w["raw_item_logs"], w["stg_item_logs"], loose)
    return quality.curation_mismatches(found).select("log_item_id", "curation_consistency_status")


add(
    "dq7_curation_consistency",
    _mismatch,
    "select log_item_id, 'error_unexpected_present_in_curated' as curation_consistency_status from logs_best where price > 0 "
    "and log_item_id not in (select log_item_id from logs_cur)",
)
_HASH = sk(*[c.replace("product_base_price_gross_eur", "price") for c in TRACKED])


def _uncollapsed(w, s, d):
    raw = w["int_item_logs"].withColumn("item_key_sk", surrogate_key("item_key"))
    ts = "time_log_created_utc"
    raw = raw.withColumn("item_scd_sk", surrogate_key(F.col("item_key"), utc_text(ts), F.col("log_item_id")))
    return quality.repeated_states(validity_windows(raw, "item_key_sk", ts, ["log_item_id"])).select(
        "item_scd_sk", "attribute_state_hash"
    )


add(
    "dq8_repeated_states",
    _uncollapsed,
    f"select {sk('item_key', "cast(ts as varchar) || '+00'", 'log_item_id')} as item_scd_sk, h as attribute_state_hash from "
    f"(select *, {_HASH} as h from logs_cur) qualify lag(h) over (partition by item_key order by ts, "
    f"{sk('item_key', "cast(ts as varchar) || '+00'", 'log_item_id')}) = h",
)
add("dq9_price_anomalies", lambda w, s, d: quality.critical_price_anomalies(w["aud_price_anomaly"]),
    f"select log_item_id, item_key, {t('ts', 'time_log_created_utc')}, {n('price', 'item_price_gross_eur')}, {n('prev', 'prev_item_price_gross_eur')}, "
    f"{r('ratio', 'price_ratio_vs_prev')}, why as anomaly_reason from price_anom where sev = 'critical'")
add("dq10_promo_anomalies", lambda w, s, d: quality.critical_promo_anomalies(w["aud_promo_anomaly"]),
    f"select promo_sk, item_key, {t('s', 'promo_start_date')}, {t('e', 'promo_end_date')}, pct as discount_pct, why as anomaly_reason from promo_anom where sev = 'critical'")
add("dq11_duplicate_item_times", lambda w, s, d: quality.duplicate_item_times(w["stg_item_logs"]),
    f"select item_key, {t('ts', 'time_log_created_utc')}, count(*) as row_cnt from stg_logs group by item_key, ts having count(*) > 1")
add("dq12_duplicate_promos", lambda w, s, d: quality.duplicate_promos(w["stg_promos"]),
    f"select item_key, {t('s', 'promo_start_date')}, {t('e', 'promo_end_date')}, kind as promo_type, {b('pct', 'discount_pct')}, count(*) as row_count "
    "from stg_promo group by item_key, s, e, kind, pct having count(*) > 1")
add("dq13_negative_values",
    lambda w, s, d: quality.negative_values(
        w["stg_purchases"].withColumn("total_basket_value_eur", F.col("total_basket_value_eur") - 100000), w["fct_order_item"]
    ),
    "select 'orders' as entity, purchase_key as entity_id from raw_buys where total < 100000 union all "
    "select 'order_items', order_item_sk from items where units <= 0 or unit_price < 0 or final < 0")


def _stretched(w):
    """History whose windows end a day late, so neighbours overlap."""
    late = F.col("valid_to_utc") + F.expr("interval 1 day")
    return w["dim_item_history"].withColumn("valid_to_utc", F.when(~F.col("is_current"), late).otherwise(F.col("valid_to_utc")))


add("dq14_overlapping_versions", lambda w, s, d: quality.overlapping_versions(_stretched(w)),
    f"select item_key_sk, item_scd_sk, {t('valid_from', 'valid_from_utc')}, {t('valid_to + interval 1 day', 'valid_to_utc')}, "
    f"{t('valid_to', 'next_valid_from_utc')} from scd where not is_current")
add("dq15_overlapping_promos", lambda w, s, d: quality.overlapping_promos(w["stg_promos"]).groupBy("item_key").agg((F.sum(F.col("copies") * F.col("overlaps")) / 2).cast("long").alias("pairs")),
    "with q as (select *, row_number() over (partition by item_key order by s, e, kind, pct) as rn from stg_promo where s is not null) "
    "select a.item_key, count(*) as pairs from q a join q b on a.item_key = b.item_key and a.rn < b.rn and a.s < b.e and b.s < a.e group by a.item_key")
add("dq16_backward_versions",
    lambda w, s, d: quality.backward_versions(
        w["dim_item_history"].withColumn("valid_to_utc", F.col("valid_to_utc") - F.expr("interval 450 day"))
    ).select("item_scd_sk"),
    "select item_scd_sk from scd where valid_to - interval 450 day <= valid_from")
add("dq17_negative_distance",
    lambda w, s, d: quality.negative_distance(
        w["fct_order"].withColumn("delivery_distance_line_meters", F.col("delivery_distance_line_meters") - 500)
    ).select("order_sk"),
    "select order_sk from ords where distance < 500")
add("dq18_value_bounds",
    lambda w, s, d: quality.value_bounds(
        w["fct_order_item"].withColumn("vat_rate_pct", F.col("vat_rate_pct") + 85)
    ).select("order_item_sk"),
    "select order_item_sk from items where vat_rate_pct + 85 > 100 or row_disc - base > 0.01")
add("dq19_order_reconciliation", lambda w, s, d: quality.order_reconciliation(w["fct_order"], w["fct_order_item"]),
    f"select order_sk, {n('total', 'total_basket_value_eur')}, {n('final', 'derived_basket_value_eur')}, {n('abs(total - final)', 'abs_diff')} from ords where abs(total - final) > 0.001")
add("dq20_promo_items", lambda w, s, d: quality.promos_without_item(w["aud_promo_coverage"]),
    f"select promo_sk, item_key, {t('s', 'promo_start_date')}, {t('e', 'promo_end_date')} from coverage where not found")
add("dq21_promo_windows", lambda w, s, d: quality.invalid_promo_windows(w["stg_promos"]),
    f"select item_key, {t('s', 'promo_start_date')}, {t('e', 'promo_end_date')}, kind as promo_type, {b('pct', 'discount_pct')} from stg_promo where e <= s or pct < 0 or pct > 100")
