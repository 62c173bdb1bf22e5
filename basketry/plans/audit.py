"""Audit marts: curation, mapping, anomalies, row flow, issues and the control board.

`run_ts` is passed in, so a result can be reproduced. Reports show at most `Settings.sample_size` ids; counts
are always over everything.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.config import Settings
from basketry.functions import count_where, quantile, safe_divide, sample_values, surrogate_key
from basketry.operators.curation import PRICE, best_per_log, drop_null_event_time, is_positive, resolve_conflicts
from basketry.operators.joins import with_totals
from basketry.operators.ranking import sizes, top_n_per_group
from basketry.operators.timeline import split_neighbours
from basketry.plans.quality import (
    CURATION_ERRORS,
    derived_by_order,
    duplicate_promos,
    revenue_reconciliation,
)

CFG = Settings()


def _sample(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    return sample_values(df, column, n).withColumnRenamed(column, name)


def _beside(row: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables next to each other."""
    return reduce(with_totals, others, row)


def _status(*cases: tuple[Column, str], otherwise: str) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for cond, label in cases[1:]:
        out = out.when(cond, label)
    return out.otherwise(otherwise)


# --------------------------------------------------------------------------------- item-log curation


def item_log_curation(raw: DataFrame, staged: DataFrame, curated: DataFrame) -> DataFrame:
    """Per log id: what curation should have done with it, and what it did."""
    good = is_positive(PRICE)
    timed = F.col("time_log_created_utc").isNotNull()
    per_log = staged.groupBy("log_item_id").agg(
        F.count(F.lit(1)).alias("stg_row_count"),
        count_where(~timed).alias("stg_rows_with_null_time"),
        count_where(timed).alias("stg_rows_with_valid_time"),
        count_where(good).alias("stg_rows_with_positive_price"),
        count_where(~good).alias("stg_rows_with_invalid_price"),
    )
    candidate = resolve_conflicts(best_per_log(drop_null_event_time(staged, "time_log_created_utc"))).select(
        "log_item_id",
        F.lit(True).alias("has_candidate"),
        F.col("time_log_created_utc").alias("best_candidate_time_log_created_utc"),
        F.col(PRICE).alias("best_candidate_price_gross_eur"),
    )
    raw_rows = raw.groupBy("log_item_id").agg(F.count(F.lit(1)).alias("raw_row_count"))
    present = curated.select(
        "log_item_id",
        F.lit(True).alias("present"),
        F.col("time_log_created_utc").alias("curated_time_log_created_utc"),
        F.col(PRICE).alias("curated_price_gross_eur"),
    )
    # a log id without a candidate lost its time slot to another one: that is tested before the price
    reason = _status(
        (F.col("stg_rows_with_valid_time") == 0, "excluded_all_rows_invalid_time"),
        (F.col("has_candidate").isNull(), "excluded_by_item_timestamp_conflict_resolution"),
        (~is_positive("best_candidate_price_gross_eur"), "excluded_best_candidate_invalid_price"),
        otherwise="included_best_candidate_positive_price",
    )
    expected, there = F.col("expected_in_curated_flag"), F.col("in_curated_flag")
    status = (
        F.when(expected & there, "ok_expected_and_present")
        .when(~expected & ~there, F.concat(F.lit("ok_expected_exclusion__"), F.col("expected_reason")))
        .when(expected, "error_expected_but_missing_in_curated")
        .otherwise("error_unexpected_present_in_curated")
    )
    return (
        per_log.join(candidate, "log_item_id", "left")
        .join(present, "log_item_id", "left")
        .join(raw_rows, "log_item_id", "left")
        .withColumn("raw_row_count", F.coalesce("raw_row_count", F.lit(0)))
        .withColumn("expected_reason", reason)
        .withColumn("expected_in_curated_flag", F.col("expected_reason").startswith("included"))
        .withColumn("in_curated_flag", F.col("present").isNotNull())
        .withColumn("curation_consistency_status", status)
        .select(
            "log_item_id",
            "raw_row_count",
            "stg_row_count",
            "stg_rows_with_null_time",
            "stg_rows_with_valid_time",
            "stg_rows_with_positive_price",
            "stg_rows_with_invalid_price",
            "best_candidate_time_log_created_utc",
            "best_candidate_price_gross_eur",
            "expected_in_curated_flag",
            "expected_reason",
            "in_curated_flag",
            "curated_time_log_created_utc",
            "curated_price_gross_eur",
            "curation_consistency_status",
        )
    )


def _size(df: DataFrame, rows: str, **distinct: str) -> DataFrame:
    """One row: number of rows and of distinct values of the given columns."""
    return sizes(df, rows, distinct)


def item_log_curation_summary(
    audit: DataFrame, raw: DataFrame, staged: DataFrame, curated: DataFrame, scd2: DataFrame, history: DataFrame,
    current: DataFrame, cfg: Settings = CFG,
) -> DataFrame:
    status, why = F.col("curation_consistency_status"), F.col("expected_reason")
    counts = audit.agg(
        F.count(F.lit(1)).alias("audit_log_item_id_count"),
        count_where(F.col("expected_in_curated_flag")).alias("expected_in_curated_count"),
        count_where(F.col("in_curated_flag")).alias("actually_in_curated_count"),
        count_where(why == "excluded_all_rows_invalid_time").alias("excluded_invalid_time_count"),
        count_where(why == "excluded_best_candidate_invalid_price").alias("excluded_invalid_price_count"),
        count_where(why == "excluded_by_item_timestamp_conflict_resolution").alias(
            "excluded_item_timestamp_conflict_count"
        ),
        count_where(status == "ok_expected_and_present").alias("ok_expected_and_present_count"),
        count_where(status.startswith("ok_expected_exclusion__")).alias("ok_expected_exclusion_count"),
        count_where(status == CURATION_ERRORS[0]).alias("error_expected_but_missing_count"),
        count_where(status == CURATION_ERRORS[1]).alias("error_unexpected_present_count"),
    )
    bad = audit.where(status.isin(*CURATION_ERRORS))
    bad_items = staged.join(bad.select("log_item_id"), "log_item_id", "left_semi")
    excluded = audit.where(status.startswith("ok_expected_exclusion__"))
    n = cfg.sample_size
    row = _beside(
        _size(raw, "raw_row_count", raw_distinct_log_item_id_count="log_item_id"),
        _size(staged, "stg_row_count", stg_distinct_log_item_id_count="log_item_id"),
        _size(curated, "curated_row_count", curated_distinct_log_item_id_count="log_item_id",
              curated_distinct_item_key_count="item_key"),
        _size(scd2, "int_item_scd2_row_count", int_item_scd2_distinct_item_key_count="item_key"),
        _size(history, "dim_item_history_row_count", dim_item_history_distinct_item_key_count="item_key"),
        _size(current, "dim_item_current_row_count", dim_item_current_distinct_item_key_count="item_key"),
        counts,
        _sample(bad, "log_item_id", "problematic_log_item_ids", n),
        _sample(bad_items, "item_key", "problematic_item_keys", n),
        bad.select("log_item_id").distinct().agg(F.count("log_item_id").alias("problematic_log_item_id_count")),
        bad_items.select("item_key").distinct().agg(F.count("item_key").alias("problematic_item_key_count")),
        _sample(excluded, "log_item_id", "expected_exclusion_log_item_ids", n),
        excluded.select("log_item_id").distinct().agg(F.count("log_item_id").alias("expected_exclusion_log_item_id_count")),
    )
    errors = F.col("error_expected_but_missing_count") + F.col("error_unexpected_present_count") > 0
    some = F.col("ok_expected_exclusion_count") > 0
    return row.withColumn(
        "overall_curation_state",
        _status((errors, "error"), (some, "warning_expected_exclusions_present"), otherwise="ok"),
    ).withColumn(
        "overall_curation_state_reason",
        _status(
            (errors, "curation_mismatch_detected"),
            (some, "expected_exclusions_present_review_if_unusual"),
            otherwise="all_expected_log_item_ids_present_with_no_mismatch",
        ),
    )


# ------------------------------------------------------------------------------------------- mappings


def order_item_match(items: DataFrame) -> DataFrame:
    """Order items that found no item or no item version."""
    no_item, no_version = F.col("item_key_sk").isNull(), F.col("item_scd_sk").isNull()
    status = _status(
        (no_item & no_version, "missing_item_entity_and_version"),
        (no_item, "missing_item_entity"),
        (no_version, "missing_item_version"),
        otherwise="matched",
    )
    return items.where(no_item | no_version).select(
        "order_item_sk", "order_sk", "purchase_key", "customer_sk", "customer_key", "order_ts_utc", "order_date",
        "item_key", "item_key_sk", "item_scd_sk", "units_in_order_item_row", "item_unit_base_price_gross_eur",
        "order_item_row_final_amount_gross_eur", status.alias("item_match_status"),
    )


def order_item_match_summary(match: DataFrame, cfg: Settings = CFG) -> DataFrame:
    n = cfg.sample_size
    row = _beside(
        match.agg(
            F.count(F.lit(1)).alias("unmatched_order_item_rows"),
            F.count_distinct("purchase_key").alias("affected_purchase_count"),
            F.count_distinct("item_key").alias("affected_item_key_count"),
            F.min("order_ts_utc").alias("first_unmatched_order_ts_utc"),
            F.max("order_ts_utc").alias("latest_unmatched_order_ts_utc"),
        ),
        _sample(match, "order_item_sk", "problematic_order_item_sks", n),
        _sample(match, "purchase_key", "problematic_purchase_keys", n),
        _sample(match, "item_key", "problematic_item_keys", n),
    )
    none = F.col("unmatched_order_item_rows") == 0
    return row.withColumn(
        "overall_match_state", _status((none, "ok"), otherwise="warning_unmatched_items_present")
    ).withColumn(
        "overall_match_state_reason",
        _status(
            (none, "all_order_items_mapped_to_item_dimensions"),
            otherwise="some_order_items_missing_item_dim_mapping",
        ),
    )


def promo_item_coverage(promos: DataFrame, current: DataFrame) -> DataFrame:
    """Promotion rules and whether their item exists."""
    known = current.select("item_key_sk", F.lit(True).alias("hit"))
    found = F.col("hit").isNotNull()
    return promos.join(known, "item_key_sk", "left").select(
        "promo_sk", "item_key_sk", "item_key", "promo_type", "discount_pct", "promo_start_date", "promo_end_date",
        found.alias("in_dim_item_current_flag"),
        _status((found, "ok_mapped"), otherwise="warning_missing_item_in_dim_current").alias("coverage_status"),
    )


def promo_item_coverage_summary(coverage: DataFrame, cfg: Settings = CFG) -> DataFrame:
    flag = F.col("in_dim_item_current_flag")
    missing = coverage.where(~flag)
    row = _beside(
        coverage.agg(
            F.count(F.lit(1)).alias("promo_row_count"),
            count_where(flag).alias("promo_rows_mapped_to_item_dim_count"),
            count_where(~flag).alias("promo_rows_missing_item_dim_count"),
        ),
        _sample(missing, "promo_sk", "missing_mapping_promo_sks", cfg.sample_size),
        _sample(missing, "item_key", "missing_mapping_item_keys", cfg.sample_size),
    )
    none = F.col("promo_rows_missing_item_dim_count") == 0
    return row.withColumn(
        "overall_coverage_state", _status((none, "ok"), otherwise="warning_missing_item_mapping")
    ).withColumn(
        "overall_coverage_state_reason",
        _status(
            (none, "all_promos_mapped_to_current_item_dim"),
            otherwise="some_promos_missing_current_item_dim_mapping",
        ),
    )


# ------------------------------------------------------------------------------------------ anomalies


def item_price_anomalies(curated: DataFrame, run_ts: dt.datetime, unit: str = "hour") -> DataFrame:
    """Every curated price against the price before it and against its item's distribution."""
    base = curated.where(F.col("time_log_created_utc").isNotNull()).select(
        "log_item_id", "item_key", "time_log_created_utc", F.col(PRICE).alias("item_price_gross_eur")
    )
    price = F.col("item_price_gross_eur")
    stats = base.groupBy("item_key").agg(
        F.count(F.lit(1)).alias("item_obs_count"),
        *[quantile(price, k, (25, 50, 75, 95)).alias(f"item_p{k}_price") for k in (25, 50, 75, 95)],
    )
    keyed = base.withColumn("__key", surrogate_key("item_key"))
    with_prev = split_neighbours(
        keyed, ["__key"], "time_log_created_utc", ["log_item_id"],
        lags={"prev_item_price_gross_eur": "item_price_gross_eur"}, unit=unit,
    ).drop("__key")
    prev, ratio = F.col("prev_item_price_gross_eur"), F.col("price_ratio_vs_prev")
    spread = F.col("item_iqr_price").cast("double")
    as_double = price.cast("double")
    high = as_double > F.col("item_p95_price").cast("double") + F.greatest(F.lit(0.5), 1.5 * spread)
    low = as_double < F.greatest(F.lit(0.0), F.col("item_p25_price").cast("double") - 1.5 * spread)
    no = F.lit(False)
    # Jump ratios 5 / 0.2 (extreme) and 3 / 0.33 (large); outliers need 8 observations.
    return (
        with_prev.join(stats, "item_key", "left")
        .withColumn("item_iqr_price", F.col("item_p75_price") - F.col("item_p25_price"))
        .withColumn("price_ratio_vs_prev", safe_divide(price, prev))
        .withColumn("invalid_price_flag", F.coalesce(price <= 0, F.lit(True)))
        .withColumn("extreme_jump_flag", F.coalesce((ratio >= 5) | (ratio <= 0.2), no))
        .withColumn("large_jump_flag", F.coalesce((ratio >= 3) | (ratio <= 0.33), no))
        .withColumn("statistical_price_outlier_flag", F.coalesce((F.col("item_obs_count") >= 8) & (high | low), no))
        .withColumn("audit_generated_at_utc", F.lit(run_ts).cast("timestamp"))
        .withColumn(
            "anomaly_reason",
            _status(
                (F.col("invalid_price_flag"), "non_positive_or_null_price"),
                (F.col("extreme_jump_flag"), "extreme_price_jump_vs_previous_log"),
                (F.col("large_jump_flag"), "large_price_jump_vs_previous_log"),
                (F.col("statistical_price_outlier_flag"), "price_statistical_outlier"),
                otherwise="normal_price_pattern",
            ),
        )
        .withColumn(
            "anomaly_severity",
            _status(
                (F.col("invalid_price_flag") | F.col("extreme_jump_flag"), "critical"),
                (F.col("large_jump_flag") | F.col("statistical_price_outlier_flag"), "warning"),
                otherwise="ok",
            ),
        )
    )


def promo_discount_anomalies(promos: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """Every discount against the valid range and against its item's, or else the overall, distribution."""
    base = promos.where(F.col("discount_pct").isNotNull()).select(
        "promo_sk", "item_key", "promo_type", "promo_start_date", "promo_end_date", "discount_pct"
    )
    pct = F.col("discount_pct")

    def stats(name: str) -> list[Column]:
        return [
            F.count(F.lit(1)).alias(f"{name}_obs_count"),
            *[quantile(pct, k, (25, 50, 75, 95)).alias(f"{name}_p{k}_discount_pct") for k in (25, 50, 75, 95)],
        ]

    per_item = base.groupBy("item_key").agg(*stats("item"))
    joined = with_totals(base.join(per_item, "item_key", "left"), base.agg(*stats("global")))

    def iqr(name: str) -> Column:
        return F.col(f"{name}_p75_discount_pct") - F.col(f"{name}_p25_discount_pct")

    def limit(name: str) -> Column:
        return F.coalesce(f"{name}_p95_discount_pct", F.lit(0)) + F.greatest(
            F.lit(5.0), 1.5 * F.coalesce(iqr(name), F.lit(0))
        )

    # An item needs 5 promotions for its own limit; 90 percent is extreme.
    own = F.coalesce("item_obs_count", F.lit(0)) >= 5
    hard, extreme = (pct < 0) | (pct > 100), pct >= 90
    return (
        joined.withColumn("item_iqr_discount_pct", iqr("item"))
        .withColumn("global_iqr_discount_pct", iqr("global"))
        .withColumn("hard_invalid_discount_flag", hard)
        .withColumn("extreme_discount_flag", extreme)
        .withColumn("statistically_high_discount_flag", pct > F.when(own, limit("item")).otherwise(limit("global")))
        .withColumn("audit_generated_at_utc", F.lit(run_ts).cast("timestamp"))
        .withColumn(
            "anomaly_reason",
            _status(
                (hard, "discount_outside_0_100"),
                (extreme, "discount_at_or_above_90"),
                (F.col("statistically_high_discount_flag"), "discount_statistical_outlier"),
                otherwise="normal_discount_range",
            ),
        )
        .withColumn(
            "anomaly_severity",
            _status(
                (hard | extreme, "critical"),
                (F.col("statistically_high_discount_flag"), "warning"),
                otherwise="ok",
            ),
        )
        .drop("item_p25_discount_pct", "item_p75_discount_pct", "global_p25_discount_pct", "global_p75_discount_pct")
    )


def _anomaly_summary(
    rows: DataFrame, checked: str, reasons: dict[str, str], subject: str, noun: str,
    samples: dict[str, tuple[str, str]], cfg: Settings,
) -> DataFrame:
    severity, reason = F.col("anomaly_severity"), F.col("anomaly_reason")
    counts = rows.agg(
        F.max("audit_generated_at_utc").alias("latest_audit_generated_at_utc"),
        F.count(F.lit(1)).alias(checked),
        *[count_where(severity == s).alias(f"{s}_rows") for s in ("ok", "warning", "critical")],
        *[count_where(reason == label).alias(name) for name, label in reasons.items()],
    )
    row = _beside(
        counts,
        *[
            _sample(rows.where(severity == level), column, name, cfg.sample_size)
            for name, (level, column) in samples.items()
        ],
    )
    critical, warning = F.col("critical_rows") > 0, F.col("warning_rows") > 0
    return row.withColumn(
        f"overall_{subject}_anomaly_state",
        _status(
            (critical, "error_critical_anomalies_present"),
            (warning, "warning_statistical_anomalies_present"),
            otherwise="ok",
        ),
    ).withColumn(
        f"overall_{subject}_anomaly_state_reason",
        _status(
            (critical, f"critical_{noun}_anomalies_need_review"),
            (warning, f"non_critical_{noun}_anomalies_detected"),
            otherwise=f"no_{noun}_anomalies_detected",
        ),
    )


def item_price_anomaly_summary(rows: DataFrame, cfg: Settings = CFG) -> DataFrame:
    reasons = {
        "statistical_outlier_rows": "price_statistical_outlier",
        "large_jump_rows": "large_price_jump_vs_previous_log",
        "extreme_jump_rows": "extreme_price_jump_vs_previous_log",
        "non_positive_or_null_rows": "non_positive_or_null_price",
    }
    samples = {
        "critical_log_item_ids": ("critical", "log_item_id"),
        "critical_item_keys": ("critical", "item_key"),
        "warning_log_item_ids": ("warning", "log_item_id"),
    }
    return _anomaly_summary(rows, "item_log_rows_checked", reasons, "item_price", "item_price", samples, cfg)


def promo_discount_anomaly_summary(rows: DataFrame, cfg: Settings = CFG) -> DataFrame:
    reasons = {
        "statistical_outlier_rows": "discount_statistical_outlier",
        "extreme_discount_rows": "discount_at_or_above_90",
        "hard_invalid_discount_rows": "discount_outside_0_100",
    }
    samples = {
        "critical_promo_sks": ("critical", "promo_sk"),
        "critical_item_keys": ("critical", "item_key"),
        "warning_promo_sks": ("warning", "promo_sk"),
    }
    return _anomaly_summary(rows, "promo_rows_checked", reasons, "promo", "promo_discount", samples, cfg)


# ------------------------------------------------------------------------------------------- row flow

# Steps as (chain, step, object, grain, rows, distinct, previous rows, expectation, rule,
# diagnostic parts). Row and distinct entries name counters of `flow_counts`; the rule is one of base
# (first step), same, fewer, mapped. A diagnostic part is (label, counter) or (label, counter, minus counter).
FLOW_STEPS = (
    ("purchase_chain", 1, "raw.purchase_logs", "purchase_key", "raw_purchase", "raw_purchase_keys", None,
     "Baseline raw purchase events.", "base", None),
    ("purchase_chain", 2, "stg_purchase_logs", "purchase_key", "stg_purchase", "stg_purchase_keys", "raw_purchase",
     "Expected same grain/near-same row count as raw after typing.", "same",
     (("stg_null_event_time_rows", "stg_purchase_no_time"), ("raw_minus_stg", "raw_purchase", "stg_purchase"))),
    ("purchase_chain", 3, "int_purchase_logs_curated_filtered", "purchase_key", "int_purchase", "int_purchase_keys",
     "stg_purchase", "Expected same grain, may drop invalid-event-time rows.", "same",
     (("potential_dropped_rows", "stg_purchase", "int_purchase"),)),
    ("order_item_chain", 1, "stg_order_items", "purchase_key x item_key", "stg_item", "stg_item_purchases", None,
     "Expected row expansion vs purchase grain because basket JSON is exploded to item grain.", "base",
     (("distinct_item_keys", "stg_item_items"),)),
    ("order_item_chain", 2, "int_order_items_with_item_price", "purchase_key x item_key", "priced",
     "stg_item_purchases", "stg_item", "Expected same row count after SCD2 time-valid price lookup.", "same",
     (("unmatched_item_rows", "priced_unmatched"),)),
    ("order_item_chain", 3, "int_order_items_with_price_then_promo", "purchase_key x item_key", "promoted",
     "stg_item_purchases", "priced",
     "Expected same row count after promo matching (one row per order_item_sk).", "same", None),
    ("order_item_chain", 4, "fct_order_item", "order_item_sk", "fct_item", "fct_item", "promoted",
     "Expected same row count as promoted intermediate.", "same", (("unmatched_item_rows", "fct_item_unmatched"),)),
    ("order_chain", 1, "fct_order", "order_sk", "fct_order", "fct_order", "int_purchase",
     "Expected one row per curated purchase.", "same", None),
    ("item_log_chain", 1, "raw.item_logs", "log_item_id", "raw_log", "raw_log_ids", None,
     "Baseline raw item-log events.", "base", (("distinct_item_keys", "raw_log_items"),)),
    ("item_log_chain", 2, "stg_item_logs", "log_item_id", "stg_log", "stg_log_ids", "raw_log",
     "Expected near-same row count after parsing/typing.", "same",
     (("stg_null_event_time_rows", "stg_log_no_time"), ("distinct_item_keys_raw", "raw_log_items"),
      ("distinct_item_keys_stg", "stg_log_items"))),
    ("item_log_chain", 3, "int_item_logs_curated_deduped", "log_item_id", "int_log", "int_log_ids", "stg_log",
     "Expected fewer or equal rows after curation (invalid/conflicting rows removed).", "fewer",
     (("curation_removed_rows", "stg_log", "int_log"), ("distinct_item_keys_curated", "int_log_items"),
      ("excluded_invalid_time", "excluded_invalid_time_count"),
      ("excluded_invalid_price", "excluded_invalid_price_count"),
      ("excluded_item_timestamp_conflict", "excluded_item_timestamp_conflict_count"))),
    ("item_dim_chain", 1, "int_item_scd2", "item_scd_sk", "scd2", "scd2", None,
     "SCD2 versions derived from curated item logs.", "base", (("distinct_item_keys_scd2", "scd2_items"),)),
    ("item_dim_chain", 2, "dim_item_history", "item_scd_sk", "history", "history", "scd2",
     "Expected same row count as SCD2 source.", "same", (("distinct_item_keys_history", "history_items"),)),
    ("item_dim_chain", 3, "dim_item_current", "item_key_sk", "current", "current", "history",
     "Expected lower row count than history (one current row per item).", "fewer",
     (("distinct_item_keys_current", "current_items"), ("distinct_item_keys_raw", "raw_log_items"))),
    ("promo_chain", 1, "raw.promos", "item_key + promo window", "raw_promo", "raw_promo_items", None,
     "Baseline raw promo rules.", "base", None),
    ("promo_chain", 2, "stg_promos", "item_key + promo window", "stg_promo", "stg_promo_items", "raw_promo",
     "Expected near-same rows after typing/standardization.", "same", None),
    ("promo_chain", 3, "dim_promo", "promo_sk", "dim_promo", "dim_promo_keys", "stg_promo",
     "Promo rule rows; should mostly map to current item dimension.", "mapped",
     (("promo_rows_missing_item_dim", "promo_missing"), ("distinct_item_keys_dim_promo", "dim_promo_items"))),
)


def flow_counts(t: dict[str, DataFrame]) -> DataFrame:
    """One row with every counter of the flow; each table is scanned once and no row is repeated per distinct count."""
    unmatched = F.col("item_key_sk").isNull() | F.col("item_scd_sk").isNull()

    def size(name: str, rows: str, flags: Mapping[str, Column] | None = None, **distinct: str) -> DataFrame:
        return sizes(t[name], rows, distinct, flags)

    purchase_time, log_time = F.col("time_order_received_utc"), F.col("time_log_created_utc")
    missing = t["dim_promo"].join(t["dim_item_current"].select("item_key_sk"), "item_key_sk", "left_anti")
    return _beside(
        size("raw_purchases", "raw_purchase", raw_purchase_keys="purchase_key"),
        size("stg_purchases", "stg_purchase", {"stg_purchase_no_time": purchase_time.isNull()},
             stg_purchase_keys="purchase_key"),
        size("int_purchases", "int_purchase", int_purchase_keys="purchase_key"),
        size("stg_order_items", "stg_item", stg_item_purchases="purchase_key", stg_item_items="item_key"),
        size("int_priced", "priced", {"priced_unmatched": unmatched}),
        size("int_promoted", "promoted"),
        size("fct_order_item", "fct_item", {"fct_item_unmatched": unmatched}),
        size("fct_order", "fct_order"),
        size("raw_item_logs", "raw_log", raw_log_ids="log_item_id", raw_log_items="item_key"),
        size("stg_item_logs", "stg_log", {"stg_log_no_time": log_time.isNull()},
             stg_log_ids="log_item_id", stg_log_items="item_key"),
        size("int_item_logs", "int_log", int_log_ids="log_item_id", int_log_items="item_key"),
        size("int_item_scd2", "scd2", scd2_items="item_key"),
        size("dim_item_history", "history", history_items="item_key"),
        size("dim_item_current", "current", current_items="item_key"),
        size("raw_promos", "raw_promo", raw_promo_items="item_key"),
        size("stg_promos", "stg_promo", stg_promo_items="item_key"),
        size("dim_promo", "dim_promo", dim_promo_keys="promo_sk", dim_promo_items="item_key"),
        missing.agg(F.count(F.lit(1)).alias("promo_missing")),
        t["aud_item_log_curation_summary"].select(
            "excluded_invalid_time_count", "excluded_invalid_price_count", "excluded_item_timestamp_conflict_count"
        ),
    )


def row_flow(tables: dict[str, DataFrame], run_ts: dt.datetime) -> DataFrame:
    """Rows, distinct keys and change against the step before, for every step of the build."""

    def step(s) -> Column:
        chain, order, name, grain, rows, distinct, previous, text, rule, parts = s
        n = F.col(rows)
        before = F.col(previous) if previous else F.lit(None).cast("long")
        ok = {"base": F.lit(True), "same": n == before, "fewer": n <= before, "mapped": F.col("promo_missing") == 0}
        bad = "attention_required" if rule == "mapped" else "review_required"
        status = F.lit("baseline_reference") if rule == "base" else F.when(ok[rule], "matches_expectation").otherwise(bad)
        notes = [
            F.concat(F.lit(f"{p[0]}="), (F.col(p[1]) - F.col(p[2]) if len(p) == 3 else F.col(p[1])).cast("string"))
            for p in parts or ()
        ]
        return F.struct(
            F.lit(chain).alias("chain_name"),
            F.lit(order).cast("long").alias("step_order"),
            F.lit(name).alias("object_name"),
            F.lit(grain).alias("primary_grain_key"),
            n.alias("row_count"),
            F.col(distinct).alias("distinct_primary_key_count"),
            before.alias("prev_step_row_count"),
            (n - before).alias("row_delta_from_prev"),
            F.lit(text).alias("expected_behavior"),
            status.alias("status"),
            (F.concat_ws("; ", *notes) if notes else F.lit(None).cast("string")).alias("diagnostic_reason"),
        )

    steps = flow_counts(tables).select(F.inline(F.array(*[step(s) for s in FLOW_STEPS])))
    return steps.select(F.lit(run_ts).cast("timestamp").alias("audit_generated_at_utc"), "*")


def row_flow_summary(flow: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """One row over the fixed list of steps."""
    status = F.col("status")

    def names(kind: str) -> Column:
        text = F.concat("chain_name", F.lit("::"), "object_name")
        hit = F.when(status == kind, F.struct("chain_name", "step_order", text.alias("text")))
        return F.slice(F.transform(F.array_sort(F.collect_list(hit)), lambda s: s["text"]), 1, cfg.sample_size)

    counted = flow.agg(
        F.count(F.lit(1)).alias("total_steps"),
        count_where(status == "matches_expectation").alias("matching_steps"),
        count_where(status == "attention_required").alias("attention_required_steps"),
        count_where(status == "review_required").alias("review_required_steps"),
        count_where(status == "baseline_reference").alias("baseline_reference_steps"),
        F.max("audit_generated_at_utc").alias("latest_audit_generated_at_utc"),
        names("review_required").alias("review_required_step_objects"),
        names("attention_required").alias("attention_required_step_objects"),
    )
    review, attention = F.col("review_required_steps") > 0, F.col("attention_required_steps") > 0
    return counted.withColumn(
        "overall_pipeline_flow_state",
        _status(
            (review, "error_review_required_steps_present"),
            (attention, "warning_attention_required_steps_present"),
            otherwise="ok",
        ),
    ).withColumn(
        "overall_pipeline_flow_state_reason",
        _status(
            (review, "one_or_more_steps_have_unexpected_row_flow"),
            (attention, "one_or_more_steps_have_known_risk_to_monitor"),
            otherwise="all_steps_match_or_are_baseline_reference",
        ),
    )


# -------------------------------------------------------------------------------------------- issues


def _json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _number(column: str) -> Column:
    return F.col(column).cast("double").alias(column)


def _issue(
    rows: DataFrame, run_ts: dt.datetime, domain: str, severity: Column, reason: str, primary: Column | str,
    secondary: Column | str | None, at: Column | None, metric: Column, context: Column,
) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(
        F.lit(run_ts).cast("timestamp").alias("issue_generated_at_utc"),
        F.lit(domain).alias("issue_domain"),
        severity.alias("issue_severity"),
        F.col(reason).alias("issue_reason"),
        col(primary).alias("primary_entity_id"),
        (F.lit(None).cast("string") if secondary is None else col(secondary).cast("string")).alias("secondary_entity_id"),
        (F.lit(None) if at is None else at).cast("timestamp").alias("event_ts_utc"),
        metric.cast("double").alias("metric_value"),
        context.alias("context_payload"),
    )


def issue_details(t: dict[str, DataFrame], run_ts: dt.datetime) -> DataFrame:
    """Row-level issues of all controls in one shape, with a JSON context."""
    severity = F.col("anomaly_severity")
    promo_day = F.col("promo_start_date").cast("timestamp")
    curation = t["aud_item_log_curation"]
    flow_bad = t["aud_row_flow"].where(F.col("status").isin("review_required", "attention_required"))
    parts = [
        _issue(
            curation.where(F.col("curation_consistency_status").isin(*CURATION_ERRORS)), run_ts,
            "item_logs_curation", F.lit("critical"), "curation_consistency_status", "log_item_id", None,
            F.col("best_candidate_time_log_created_utc"), F.col("best_candidate_price_gross_eur"),
            _json("raw_row_count", "stg_row_count", "expected_reason", "expected_in_curated_flag", "in_curated_flag"),
        ),
        _issue(
            t["aud_order_item_match"], run_ts, "order_item_item_mapping", F.lit("warning"), "item_match_status",
            "order_item_sk", "item_key", F.col("order_ts_utc"), F.col("order_item_row_final_amount_gross_eur"),
            _json("purchase_key", "customer_key", "item_key_sk", "item_scd_sk", "units_in_order_item_row",
                  _number("item_unit_base_price_gross_eur")),
        ),
        _issue(
            t["aud_promo_coverage"].where(~F.col("in_dim_item_current_flag")), run_ts, "promo_item_mapping",
            F.lit("warning"), "coverage_status", "promo_sk", "item_key", promo_day, F.col("discount_pct"),
            _json("promo_type", "promo_start_date", "promo_end_date", "in_dim_item_current_flag"),
        ),
        _issue(
            t["aud_promo_anomaly"].where(severity != "ok"), run_ts, "promo_discount_anomaly", severity,
            "anomaly_reason", "promo_sk", "item_key", promo_day, F.col("discount_pct"),
            _json("promo_type", "promo_start_date", "promo_end_date", "item_obs_count", "item_p95_discount_pct",
                  "global_p95_discount_pct", "hard_invalid_discount_flag", "extreme_discount_flag",
                  "statistically_high_discount_flag"),
        ),
        _issue(
            t["aud_price_anomaly"].where(severity != "ok"), run_ts, "item_price_anomaly", severity, "anomaly_reason",
            "log_item_id", "item_key", F.col("time_log_created_utc"), F.col("item_price_gross_eur"),
            _json(_number("prev_item_price_gross_eur"), "price_ratio_vs_prev", "item_obs_count",
                  _number("item_p95_price"), "invalid_price_flag", "extreme_jump_flag", "large_jump_flag",
                  "statistical_price_outlier_flag"),
        ),
        _issue(
            flow_bad, run_ts, "pipeline_row_flow",
            F.when(F.col("status") == "review_required", "critical").otherwise("warning"), "status",
            F.concat("chain_name", F.lit("::"), "object_name"), "step_order", F.col("audit_generated_at_utc"),
            F.col("row_delta_from_prev"),
            _json("chain_name", "object_name", "primary_grain_key", "row_count", "distinct_primary_key_count",
                  "prev_step_row_count", "status", "expected_behavior", "diagnostic_reason"),
        ),
        _issue(
            revenue_reconciliation(t["raw_purchases"], t["fct_order"], t["fct_order_item"]), run_ts,
            "order_revenue_reconciliation", F.lit("critical"), "failure_reason", "purchase_key", None, None,
            F.col("abs_diff"),
            _json(_number("derived_basket_value_eur"), _number("raw_total_basket_value_eur"), "raw_row_count",
                  "raw_distinct_total_count"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


# -------------------------------------------------------------------------------------- control board

# Descriptions of the controls.
CONTROL_TEXT = {
    "item_logs_curation": "Checks curated item-log consistency vs expected inclusion/exclusion rules.",
    "order_item_item_mapping": "Checks order-item rows resolve to item entity/version keys.",
    "promo_item_mapping": "Checks promo rules map to existing item keys in current item dimension.",
    "promo_discount_anomaly": "Checks promo discounts for critical or statistical anomalies.",
    "item_price_anomaly": "Checks item-price history for invalid values and unusual jumps/outliers.",
    "pipeline_row_flow": "Checks row-flow deltas by chain/layer against expected behavior.",
    "order_revenue_reconciliation": "Checks each order derived basket total equals raw purchase basket total.",
}


def control_status(t: dict[str, DataFrame], run_ts: dt.datetime, cfg: Settings = CFG) -> DataFrame:
    """One row per control: state, severity, counts and the first issues as JSON."""

    def control(df: DataFrame, name: str, state: str, bad: Column, primary: str, secondary: Column | str) -> DataFrame:
        level = _status(
            (F.col(state).startswith("error"), "critical"), (F.col(state).startswith("warning"), "warning"),
            otherwise="ok",
        )
        return df.select(
            F.lit(name).alias("control_name"),
            F.col(state).alias("status"),
            level.alias("severity"),
            bad.cast("long").alias("problematic_row_count"),
            F.col(f"{state}_reason").alias("reason"),
            F.col(primary).alias("sample_primary_ids"),
            (F.col(secondary) if isinstance(secondary, str) else secondary).alias("sample_secondary_ids"),
        )

    # the stored issues hold the orders that do not reconcile; nothing is reconciled again
    failures = t["aud_issue_details"].where(F.col("issue_domain") == "order_revenue_reconciliation")
    none = F.col("n") == 0
    revenue = _beside(
        failures.agg(F.count(F.lit(1)).alias("n")), _sample(failures, "primary_entity_id", "keys", cfg.sample_size)
    ).withColumn(
        "state", _status((none, "ok"), otherwise="error_order_revenue_reconciliation_mismatch")
    ).withColumn(
        "state_reason",
        _status(
            (none, "all_orders_reconcile_between_derived_and_raw_totals"),
            otherwise="one_or_more_orders_do_not_reconcile_between_derived_and_raw_totals",
        ),
    )
    both = F.col("critical_rows") + F.col("warning_rows")
    controls = reduce(
        DataFrame.unionByName,
        [
            control(
                t["aud_item_log_curation_summary"], "item_logs_curation", "overall_curation_state",
                F.col("error_expected_but_missing_count") + F.col("error_unexpected_present_count"),
                "problematic_log_item_ids", "problematic_item_keys",
            ),
            control(
                t["aud_order_item_match_summary"], "order_item_item_mapping", "overall_match_state",
                F.col("unmatched_order_item_rows"), "problematic_order_item_sks", "problematic_item_keys",
            ),
            control(
                t["aud_promo_coverage_summary"], "promo_item_mapping", "overall_coverage_state",
                F.col("promo_rows_missing_item_dim_count"), "missing_mapping_promo_sks", "missing_mapping_item_keys",
            ),
            control(
                t["aud_promo_anomaly_summary"], "promo_discount_anomaly", "overall_promo_anomaly_state", both,
                "critical_promo_sks", "critical_item_keys",
            ),
            control(
                t["aud_price_anomaly_summary"], "item_price_anomaly", "overall_item_price_anomaly_state", both,
                "critical_log_item_ids", "critical_item_keys",
            ),
            control(
                t["aud_row_flow_summary"], "pipeline_row_flow", "overall_pipeline_flow_state",
                F.col("review_required_steps") + F.col("attention_required_steps"),
                "review_required_step_objects", "attention_required_step_objects",
            ),
            control(
                revenue, "order_revenue_reconciliation", "state", F.col("n"), "keys",
                F.array().cast("array<string>"),
            ),
        ],
    )
    issues = t["aud_issue_details"]
    counts = issues.groupBy("issue_domain").agg(F.count(F.lit(1)).alias("failing_issue_count"))
    order = [F.desc("issue_severity"), *[F.asc_nulls_first(c) for c in ("issue_reason", "primary_entity_id", "secondary_entity_id")]]
    first = top_n_per_group(issues, ["issue_domain"], order, cfg.sample_size, "place")
    text = _json("issue_severity", "issue_reason", "primary_entity_id", "secondary_entity_id", "event_ts_utc",
                 "metric_value", "context_payload")
    shown = first.groupBy("issue_domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda s: s["t"]).alias(
            "failing_rows_with_reason"
        )
    )
    described = F.create_map(*[F.lit(x) for pair in CONTROL_TEXT.items() for x in pair])
    rolled = counts.join(shown, "issue_domain").withColumnRenamed("issue_domain", "control_name")
    return controls.join(rolled, "control_name", "left").select(
        F.lit(run_ts).cast("timestamp").alias("audit_generated_at_utc"),
        "control_name",
        F.coalesce(described[F.col("control_name")], F.lit("Consolidated quality control.")).alias("control_description"),
        "status",
        "severity",
        "problematic_row_count",
        "reason",
        F.coalesce("failing_issue_count", F.lit(0)).alias("failing_issue_count"),
        F.coalesce("failing_rows_with_reason", F.array().cast("array<string>")).alias("failing_rows_with_reason"),
        "sample_primary_ids",
        "sample_secondary_ids",
    )


# ---------------------------------------------------------------------------------- ad-hoc validation


def validation_checks(t: dict[str, DataFrame]) -> DataFrame:
    """Layer counts, orphans, parsing, version and promotion checks as (section, check_name, check_value)."""
    one = F.count(F.lit(1))

    def null(c: str) -> Column:
        return F.count_if(F.col(c).isNull())

    def rows(section: str, df: DataFrame, **values: Column) -> DataFrame:
        counted = df.agg(*[v.cast("string").alias(k) for k, v in values.items()])
        return counted.unpivot([], list(values), "check_name", "check_value").select(
            F.lit(section).alias("section"), "check_name", "check_value"
        )

    items, orders = t["fct_order_item"], t["fct_order"]
    staged, curated = t["stg_item_logs"], t["int_item_logs"]
    purchases, basket = t["stg_purchases"], t["stg_order_items"]
    history, promos = t["int_item_scd2"], t["stg_promos"]
    diff = derived_by_order(orders, items).withColumn(
        "d", F.abs(F.col("total_basket_value_eur") - F.col("derived_basket_value_eur"))
    )
    log_groups = staged.groupBy("log_item_id").agg(one.alias("c")).where("c > 1")
    same_time = t["int_purchases"].groupBy("customer_key", "time_order_received_utc").agg(one.alias("c")).where("c > 1")
    same_start = history.groupBy("item_key", "valid_from_utc").agg(one.alias("c")).where("c > 1")
    open_window = F.col("valid_from_utc") == F.col("valid_to_utc")
    priced = t["int_priced"]
    price = F.col(PRICE)
    over = F.col("order_item_row_discount_amount_gross_eur") - F.col("order_item_row_base_amount_gross_eur")
    parts = [
        rows("layers", purchases, stg_purchase_rows=one),
        rows("layers", t["int_purchases"], int_purchase_rows=one),
        rows("layers", orders, fct_order_rows=one),
        rows("layers", basket, stg_order_items_rows=one),
        rows("layers", items, fct_order_item_rows=one),
        rows("layers", items.join(orders.select("order_sk"), "order_sk", "left_anti"),
             orphan_fct_order_item_without_order=one),
        rows("layers", orders.join(items.select("order_sk"), "order_sk", "left_anti"), fct_order_without_items=one),
        rows("layers", diff, order_reconciliation_max_abs_diff=F.max("d"),
             order_reconciliation_over_0_001_cnt=F.count_if(F.col("d") > 0.001)),
        rows("layers", duplicate_promos(promos), duplicate_promo_definitions_cnt=one),
        rows("layers", priced, items_missing_scd_match_cnt=null("item_scd_sk")),
        rows("item_logs", staged, stg_item_logs_rows=one, stg_distinct_log_item_id=F.count_distinct("log_item_id"),
             stg_invalid_price_null_or_non_positive=F.count_if(F.coalesce(price <= 0, F.lit(True))),
             stg_brand_name_null_rows=null("brand_name")),
        rows("item_logs", curated, curated_rows=one, curated_distinct_log_item_id=F.count_distinct("log_item_id"),
             curated_brand_name_null_rows=null("brand_name")),
        rows("item_logs", log_groups, stg_duplicate_log_item_groups=one,
             stg_duplicate_extra_rows=F.coalesce(F.sum(F.col("c") - 1), F.lit(0))),
        rows("purchases", t["raw_purchases"], raw_purchase_rows=one),
        rows("purchases", purchases, stg_time_order_received_null=null("time_order_received_utc"),
             stg_item_basket_json_null=null("item_basket_description_raw"),
             stg_total_basket_value_null=null("total_basket_value_eur"), stg_service_fee_null=null("service_fee_eur"),
             stg_courier_fee_null=null("courier_base_fee_eur"),
             stg_delivery_distance_null=null("delivery_distance_line_meters")),
        rows("purchases", purchases.join(basket.select("purchase_key"), "purchase_key", "left_anti"),
             stg_orders_without_exploded_items=one),
        rows("versions", history, scd_rows=one, scd_current_rows=F.count_if(F.col("is_current")),
             scd_zero_length_rows=F.count_if(open_window)),
        rows("versions", same_start, item_keys_with_same_timestamp_multi_logs=one),
        rows("promos", same_time, customers_with_same_timestamp_multi_orders=one,
             max_orders_same_customer_same_ts=F.coalesce(F.max("c"), F.lit(0))),
        rows("promos", multi_promo_items(priced, promos), order_items_with_multiple_promo_matches=one),
        rows("promos", promos.join(t["dim_item_history"].select("item_key"), "item_key", "left_anti"),
             promo_rows_for_unknown_items=one),
        rows("promos", items, fct_order_item_discount_gt_base_rows=F.count_if(over > 0.000001)),
    ]
    return reduce(DataFrame.unionByName, parts)


def multi_promo_items(priced: DataFrame, promos: DataFrame) -> DataFrame:
    """Order items on whose date more than one promotion of the item is active.

    The number of active promotions per item changes only at window edges: it is the running sum of starts
    minus ends up to the date, so order items are never paired with windows.
    """
    valid = promos.where(
        F.col("item_key").isNotNull() & (F.col("promo_start_date") < F.col("promo_end_date"))
    )
    edges = (
        valid.select("item_key", F.col("promo_start_date").alias("day"), F.lit(1).alias("step"))
        .unionByName(valid.select("item_key", F.col("promo_end_date").alias("day"), F.lit(-1).alias("step")))
        .groupBy("item_key", "day")
        .agg(F.sum("step").alias("step"))
    )
    # one row per item and edge date: a group is as long as the calendar
    w = W.partitionBy("item_key").orderBy("day")
    spans = edges.select(
        "item_key",
        F.col("day").alias("valid_from_utc"),
        F.sum("step").over(w).alias("active"),
        F.lead("day").over(w).alias("until"),
    ).where((F.col("active") > 1) & F.col("until").isNotNull())
    days = spans.select(
        "item_key",
        F.explode(F.sequence("valid_from_utc", F.date_sub("until", 1), F.expr("interval 1 day"))).alias("order_date_berlin"),
    )
    return priced.select("order_item_sk", "item_key", "order_date_berlin").join(
        days, ["item_key", "order_date_berlin"], "left_semi"
    )
