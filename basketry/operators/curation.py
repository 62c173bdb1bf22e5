"""Filters and trust-ranked deduplication of event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.config import Settings
from basketry.sources.raw import dev_date_window

PRICE = "product_base_price_gross_eur"


def drop_null_event_time(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def is_positive(column: str) -> Column:
    return F.coalesce(F.col(column) > 0, F.lit(False))


def require_positive(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) > 0)


def dedupe_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best row per key.

    Filtering a ranking at 1 lets Spark keep only the local best of each task before the shuffle
    (window group limit), so a key with very many copies reaches one task with at most one row per task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def best_per_log(logs: DataFrame) -> DataFrame:
    """One row per log id: positive price first, then the latest event, then payload text."""
    order = [is_positive(PRICE).desc(), F.desc("time_log_created_utc"), F.desc("payload_raw")]
    return dedupe_best(logs, ["log_item_id"], order)


def resolve_conflicts(best: DataFrame) -> DataFrame:
    """One row per item and event time among the best rows of different log ids."""
    order = [
        is_positive(PRICE).desc(),
        F.desc_nulls_last("time_item_created_in_source_utc"),
        F.desc("log_item_id"),
        F.desc("payload_raw"),
    ]
    return dedupe_best(best, ["item_key", "time_log_created_utc"], order)


def curate_item_logs(staged: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Trusted item-log stream: valid time, best row per log id, no time conflicts, positive price."""
    timed = dev_date_window(drop_null_event_time(staged, "time_log_created_utc"), "time_log_created_utc", cfg)
    return require_positive(resolve_conflicts(best_per_log(timed)), PRICE)


def curate_purchases(staged: DataFrame, cfg: Settings = Settings(), cutoff=None) -> DataFrame:
    """Purchases with a valid event time; `cutoff` is a literal so a partitioned scan can prune."""
    timed = drop_null_event_time(staged, "time_order_received_utc")
    timed = dev_date_window(timed, "time_order_received_utc", cfg)
    if cutoff is not None:
        timed = timed.where(F.col("time_order_received_utc") >= F.lit(cutoff))
    return timed
