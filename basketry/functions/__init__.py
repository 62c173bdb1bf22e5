from basketry.functions.scalars import (
    daypart,
    key_text,
    local_time,
    month_of,
    pack_key,
    parse_date,
    parse_event_time,
    plain_number,
    preferred_name,
    safe_divide,
    short_key,
    sunday_week,
    surrogate_key,
    try_money,
    unpack_key,
)
from basketry.functions.aggregates import (
    count_where,
    distinct_list,
    quantile,
    sample_values,
    sum_where,
)

__all__ = [
    "count_where",
    "daypart",
    "distinct_list",
    "key_text",
    "local_time",
    "month_of",
    "pack_key",
    "parse_date",
    "parse_event_time",
    "plain_number",
    "preferred_name",
    "quantile",
    "safe_divide",
    "sample_values",
    "short_key",
    "sum_where",
    "sunday_week",
    "surrogate_key",
    "try_money",
    "unpack_key",
]
