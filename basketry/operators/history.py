"""Slowly changing dimension (type 2): change detection and validity windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.config import OPEN_END
from basketry.functions import surrogate_key
from basketry.functions.scalars import utc_text
from basketry.operators.timeline import hot_and_busy, split_neighbours

# Attributes whose change starts a version, and the columns of the history.
TRACKED = (
    "item_name_en",
    "item_name_de",
    "item_name_preferred",
    "item_category",
    "brand_name",
    "number_of_units",
    "weight_in_grams",
    "product_base_price_gross_eur",
    "vat_rate_pct",
)
HISTORY_COLUMNS = (
    "item_scd_sk",
    "item_key_sk",
    "item_key",
    "log_item_id",
    "valid_from_utc",
    "valid_to_utc",
    "is_current",
    *TRACKED,
    "time_item_created_in_source_utc",
)


def open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp")


def state_hash(columns: Sequence[str] = TRACKED) -> Column:
    return surrogate_key(*columns)


def with_previous_state(
    df: DataFrame, key: str, ts: str, ties: Sequence[str], tracked: Sequence[str], unit: str = "hour",
    busy: DataFrame | None = None, hot: DataFrame | str | None = "all",
) -> DataFrame:
    """Adds `attribute_state_hash` and the hash of the row before it on the same timeline."""
    hashed = df.withColumn("attribute_state_hash", state_hash(tracked))
    return split_neighbours(
        hashed, [key], ts, ties, lags={"previous_attribute_state_hash": "attribute_state_hash"}, unit=unit, busy=busy, hot=hot
    )


def change_events(with_state: DataFrame) -> DataFrame:
    """Drops events that repeat the state before them; keeps the first of every run."""
    previous = F.col("previous_attribute_state_hash")
    return with_state.where(previous.isNull() | (previous != F.col("attribute_state_hash")))


def validity_windows(
    events: DataFrame, key: str, ts: str, ties: Sequence[str], unit: str = "hour",
    busy: DataFrame | None = None, hot: DataFrame | str | None = "all",
) -> DataFrame:
    """Adds [valid_from_utc, valid_to_utc) and is_current; the last version stays open."""
    nexted = split_neighbours(events, [key], ts, ties, leads={"__next_from": ts}, unit=unit, busy=busy, hot=hot)
    return (
        nexted.withColumn("valid_from_utc", F.col(ts))
        .withColumn("valid_to_utc", F.coalesce("__next_from", open_end()))
        .withColumn("is_current", F.col("valid_to_utc") == open_end())
        .drop("__next_from")
    )


def version_key(valid_from: str) -> Column:
    """Key of an item version: its item, its start and its log id."""
    return surrogate_key(F.col("item_key"), utc_text(valid_from), F.col("log_item_id"))


def item_scd2(curated: DataFrame, unit: str = "hour", rows_per_task: int = 1_000_000) -> DataFrame:
    """Item versions from the curated item-log stream."""
    events = curated.withColumn("item_key_sk", surrogate_key("item_key"))
    ts, ties = "time_log_created_utc", ["log_item_id"]
    crowded = hot_and_busy(events, ["item_key_sk"], ts, unit, rows_per_task)
    changed = change_events(with_previous_state(events, "item_key_sk", ts, ties, TRACKED, unit, **crowded))
    versions = validity_windows(changed, "item_key_sk", ts, ties, unit, **crowded)
    return versions.withColumn("item_scd_sk", version_key(ts)).select(*HISTORY_COLUMNS)
