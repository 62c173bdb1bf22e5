"""All tunable values of the library in one immutable object."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # development sampling
    dev_sampling: bool = False
    dev_start: str = "2023-11-01"
    dev_end: str = "2024-02-01"

    # incremental processing
    lookback_enabled: bool = True
    lookback_days: int = 7
    watermarks_enabled: bool = True
    watermark_floor: dt.datetime = dt.datetime(2020, 1, 1)
    publish_tag: str = "scheduled"
    target_name: str = "dev"

    # basket affinity
    min_pair_orders: int = 50
    top_products: int = 30
    strong_lift: float = 1.3
    high_support: float = 0.02
    neutral_lift_low: float = 0.9
    neutral_lift_high: float = 1.1

    # calendar
    calendar_start: str = "2019-01-01"
    calendar_end: str = "2026-12-31"
    business_zone: str = "Europe/Berlin"

    # physical limits: a side is broadcast only after it was counted below this many rows and bytes,
    # otherwise the shuffle strategy of the same operator runs
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64_000_000
    broadcast_rows_per_key: int = 64
    # a key and date with more facts is dealt to several tasks, and how many such keys may be broadcast
    rows_per_task: int = 1_000_000
    busy_spots: int = 10_000
    # time unit that splits one key's timeline into independently sorted pieces
    split_unit: str = "hour"

    # how many ids or issue rows an audit report shows
    sample_size: int = 200

    # Category names used by the pair labels and the summary rows.
    snack_category: str = "Crisp & Snacks"
    dip_category: str = "Cheese Crackers, Breadsticks & Dipping"
    sweet_categories: tuple[str, ...] = ("Chocolate", "Other Confectionary")
    # Fixed value: product-name pattern (SQL LIKE, lower case) moved to another category.
    category_remaps: tuple[tuple[str, str], ...] = field(
        default=(("%tony%chocolonely%dark milk%brownie%180%", "Chocolate"),)
    )


# Open end of a validity window and the text that stands for null in keys.
OPEN_END = "9999-12-31 23:59:59"
NULL_KEY_TEXT = "_dbt_null_"

# Daypart buckets as (last hour of the bucket, label); hours outside are night.
NIGHT = "Night (23-05)"
DAYPARTS_FOUR = (
    (6, 10, "Morning (06-10)"),
    (11, 16, "Afternoon (11-16)"),
    (17, 22, "Evening (17-22)"),
)
DAYPARTS_FIVE = (
    (6, 10, "Morning (06-10)"),
    (11, 14, "Lunch (11-14)"),
    (15, 17, "Afternoon (15-17)"),
    (18, 22, "Evening (18-22)"),
)
